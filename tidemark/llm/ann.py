"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced tree over a bounded sample: a node is split at the median along the line between two means,
so leaves hold equally many sampled vectors; a dense region gets as many lists as its rows ask for. The centroids with a
graph of their near neighbours are small and held in memory by every worker. A vector is listed at its nearest
centroid, and near a boundary at up to REPLICAS ones whose distance is at most (1 + BOUNDARY) times the nearest. A query
walks the graph to its nearest centroid and from there to all centroids within a ratio of that distance; only these lists are
searched, and there is no other cap on them. The ratio is fitted: up to PROBES vectors of the sample look for their nearest ones in it, and
the ratio is the least at which their lists would hold RECALL of these. As the sample is thinner than the table, its neighbours lie
farther off than the table's, so that the ratio is on the safe side. Spark joins queries and lists, and every
distance is computed on the original vectors in double precision, so scores are exact and only a neighbour in no searched list is missed.

Equal vectors form a class that is listed and searched once and knows its k + 1 smallest ids. Lists of more than CHUNK
vectors, and queries of more than CHUNK a list, are dealt to several tasks.

Bounds: the sample has at most SAMPLE_VALUES numbers (rows times dimension, 262,144 rows of dimension 64) and 1 / PER_LIST as many
lists; up to there a list takes about LIST vectors, beyond it lists grow with the table. Every row is listed at any size.

Vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate. Vectors of
different lengths are never compared. Each row is a vector, repeated ones and those of a shared vec_id too; a query
leaves out its own row and no other. A null vec_id is never a query and comes last among ties. Further columns, of any name, are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, staged

LIST = 128
PER_LIST = 16
SAMPLE_VALUES = 1 << 24
REPLICAS = 4
BOUNDARY = 0.3
RECALL = 0.97
PROBES = 400
DEGREE = 16
BEAM = 16
CHUNK = 2000
#: Queries whose finds a task holds at once.
HELD = 100_000
_PAIRS = 1 << 15
_LARGE = 1e100


class Lists(NamedTuple):
    """Centroids of one dimension, the graph of their neighbours, and where searches begin. Vectors are divided by scale first."""

    centroids: np.ndarray
    near: np.ndarray
    entries: np.ndarray
    scale: float
    ratio: float = 1.0


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of 2^j leaves (the power of two next to lists) of equal size, in the order of the tree."""
    leaves = [x]
    for _ in range(max(0, round(math.log2(max(1, lists))))):
        halves = []
        for v in leaves:
            a, b = v[0], v[np.argmax(((v - v[0]) ** 2).sum(axis=1))]
            for _ in range(4):
                low = np.argsort(v @ (b - a), kind="stable")
                half = len(v) // 2
                a, b = v[low[:half]].mean(axis=0), v[low[half:]].mean(axis=0)
            halves += [v[low[:half]], v[low[half:]]]
        leaves = halves
    return np.array([v.mean(axis=0) for v in leaves])


def build_lists(sample: np.ndarray, lists: int) -> Lists:
    scale = float(np.abs(sample).max()) or 1.0
    c = balanced_centroids(sample / scale, min(lists, max(1, len(sample) // 2)))
    norms, near = (c**2).sum(axis=1), []
    degree = min(DEGREE, len(c) - 1)
    for start in range(0, len(c), 1024):
        d = norms[None] - 2 * c[start : start + 1024] @ c.T
        d[np.arange(len(d)), start + np.arange(len(d))] = np.inf
        near.append(np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree else np.zeros((len(d), 0), np.int64))
    index = Lists(c, np.concatenate(near).astype(np.int32), np.arange(0, len(c), max(1, math.isqrt(len(c)) // 2)), scale)
    return index._replace(ratio=_fitted_ratio(index, sample / scale))


def _fitted_ratio(index: Lists, x: np.ndarray, k: int = 10) -> float:
    """How far from its nearest centroid a probe has to look, relative to that one's distance, to find RECALL of its k nearest in x."""
    x = x[:: max(1, len(x) // 50_000)]
    k, needed = min(k, len(x) - 1), [np.ones(1)]
    probes = np.arange(0, len(x), max(1, len(x) // PROBES))
    norms = (x**2).sum(axis=1)
    for start in range(0, len(probes) if k else 0, 50):
        at = probes[start : start + 50]
        apart = norms[None] - 2 * x[at] @ x.T
        apart[np.arange(len(at)), at] = np.inf
        near = np.argpartition(apart, k - 1, axis=1)[:, :k]
        rows, lists = boundary_lists(index, x[near.ravel()] * index.scale)
        ids = at[rows // k]
        found = np.full(near.size, np.inf)
        np.minimum.at(found, rows, _pair_distances(index, x, ids, lists))
        least = np.sqrt(np.maximum(0, ((index.centroids**2).sum(axis=1)[None] - 2 * x[at] @ index.centroids.T).min(axis=1) + norms[at]))
        needed.append(found / np.maximum(np.repeat(least, k), 1e-12 * np.sqrt(norms.max())))
    return max(1.0, float(np.quantile(np.concatenate(needed), RECALL)))


def _routed(index: Lists, x: np.ndarray) -> np.ndarray:
    return np.clip(x / index.scale, -_LARGE, _LARGE)


def _pair_distances(index: Lists, x: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for s in range(0, len(rows), _PAIRS):
        part = slice(s, s + _PAIRS)
        out[part] = np.sqrt(((x[rows[part]] - index.centroids[ids[part]]) ** 2).sum(axis=1))
    return out


def nearest_lists(index: Lists, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (as routed) the numbers of the nearest centroids that a walk of the graph finds, nearest first, and their distances."""
    n, beam = len(x), min(beam, len(index.centroids))
    row = np.arange(n)
    d = np.stack([_pair_distances(index, x, row, np.full(n, e)) for e in index.entries], axis=1)
    order = np.argsort(d, axis=1, kind="stable")[:, :beam]
    ids, d = index.entries[order], np.take_along_axis(d, order, axis=1)
    done = np.zeros(ids.shape, bool)
    while index.near.shape[1]:
        open_d = np.where(done, np.inf, d)
        pick = open_d.argmin(axis=1)
        live = np.flatnonzero(open_d[row, pick] < np.inf)
        if not len(live):
            break
        done[live, pick[live]] = True
        more = index.near[ids[live, pick[live]]]
        new = _pair_distances(index, x, np.repeat(live, more.shape[1]), more.ravel()).reshape(more.shape)
        new[(more[:, :, None] == ids[live][:, None, :]).any(axis=2)] = np.inf
        all_ids, all_d = np.concatenate([ids[live], more], axis=1), np.concatenate([d[live], new], axis=1)
        all_done = np.concatenate([done[live], np.isinf(new)], axis=1)
        width = min(beam, all_ids.shape[1])
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        if width > ids.shape[1]:  # the beam fills up from the entries
            pad = ((0, 0), (0, width - ids.shape[1]))
            ids, d, done = np.pad(ids, pad), np.pad(d, pad, constant_values=np.inf), np.pad(done, pad, constant_values=True)
        ids[live], d[live], done[live] = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_d, all_done))
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)


def boundary_lists(index: Lists, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, list): where vectors are listed."""
    ids, d = nearest_lists(index, _routed(index, x))
    ids, d = ids[:, :REPLICAS], d[:, :REPLICAS]
    rows, at = np.nonzero(d <= (1 + BOUNDARY) * d[:, :1])
    return rows, ids[rows, at]


def searched_lists(index: Lists, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, list): the lists within the distance ratio, reached over the graph."""
    x = _routed(index, x)
    ids, d = nearest_lists(index, x)
    reach = index.ratio * d[:, 0]
    seen = np.zeros((len(x), len(index.centroids)), bool)
    chosen = seen.copy()
    rows, at = np.nonzero(d <= reach[:, None])
    ids = ids[rows, at]
    seen[rows, ids] = True
    while len(rows):
        chosen[rows, ids] = True
        new = np.zeros_like(seen)
        new[np.repeat(rows, index.near.shape[1]), index.near[ids].ravel()] = True
        new &= ~seen
        seen |= new
        rows, ids = np.nonzero(new)
        close = _pair_distances(index, x, rows, ids) <= reach[rows]
        rows, ids = rows[close], ids[close]
    return np.nonzero(chosen)


def _matrix(column, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def _listing(lists, choose, carried: tuple[str, ...]):
    """Rows of carried columns for each list that choose gives; vectors of a length that the sample lacks stand in list 0."""

    def run(batches):
        index = lists.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                of_dim = batch.filter(pa.array(dims == dim))
                for start in range(0, of_dim.num_rows, 256):
                    part = of_dim.slice(start, 256)
                    if int(dim) in index:
                        rows, ids = choose(index[int(dim)], _matrix(part.column("embedding"), part.num_rows))
                    else:
                        rows, ids = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in carried), pa.array(ids.astype(np.int32))], names=[*carried, "list"])

    return run


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of the vector q to the rows of x, in double precision, safe from overflow."""
    apart = x - q
    largest = np.abs(apart).max(axis=1, initial=0.0)
    odd = (largest > _LARGE) | ((largest < 1 / _LARGE) & (largest > 0))
    out = np.sqrt((np.where(odd[:, None], 0.0, apart) ** 2).sum(axis=1))
    if odd.any():
        unit = largest[odd]
        out[odd] = np.sqrt(((apart[odd] / unit[:, None]) ** 2).sum(axis=1)) * unit
    return out


class _Posting(NamedTuple):
    """Vectors of one list (or a chunk of it), as they are and scaled by unit for a first, rough comparison."""

    x: np.ndarray
    scaled: np.ndarray
    norms: np.ndarray
    unit: float
    rep: np.ndarray
    first: np.ndarray
    none: np.ndarray
    ids: pa.Array


def _posting(parts: list[pa.RecordBatch]) -> _Posting:
    rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    x = _matrix(rows.column("embedding"), rows.num_rows)
    unit = float(np.abs(x).max())
    first = rows.column("first")
    return _Posting(x, x / unit, ((x / unit) ** 2).sum(axis=1), unit, rows.column("number").to_numpy(), first.fill_null(0).to_numpy(), np.asarray(first.is_null()), rows.column("ids"))


class _Found(NamedTuple):
    """The nearest classes that a query has met so far, nearest first, each once."""

    score: np.ndarray
    rep: np.ndarray
    first: np.ndarray
    none: np.ndarray
    ids: list


def _search(listed: _Posting, asking: pa.RecordBatch, held: dict[int, _Found], k: int) -> None:
    q, number = _matrix(asking.column("embedding"), asking.num_rows), asking.column("number").to_numpy()
    for start in range(0, len(q), 256):
        scaled = q[start : start + 256] / listed.unit
        own = (scaled**2).sum(axis=1)
        rough = listed.norms[None] - 2 * scaled @ listed.scaled.T  # squared distances but for the query's own norm
        slack = 1e-12 * (listed.norms.max() + own) * q.shape[1]
        width = min(k, len(listed.x))
        reach = np.partition(rough, width - 1, axis=1)[:, width - 1]
        for i in range(len(scaled)):
            before = held.get(int(number[start + i]))
            limit = reach[i]
            if before is not None and len(before.score) == k:
                limit = min(limit, (before.score[-1] / listed.unit) ** 2 * (1 + 1e-12) - own[i])
            at = np.flatnonzero(~(rough[i] > limit + slack[i]))
            if not len(at):
                continue
            score, rep, first, none, ids = distances(q[start + i], listed.x[at]), listed.rep[at], listed.first[at], listed.none[at], None
            if before is not None:
                new = ~np.isin(rep, before.rep)
                at, score, rep, first, none = at[new], score[new], rep[new], first[new], none[new]
            best = np.lexsort((first, none, score))[:k]
            ids = listed.ids.take(pa.array(at[best])).to_pylist()
            one = _Found(score[best], rep[best], first[best], none[best], ids)
            if before is not None:
                both = [np.concatenate([getattr(before, c), getattr(one, c)]) for c in ("score", "rep", "first", "none")]
                best, ids = np.lexsort((both[2], both[3], both[0]))[:k], before.ids + ids
                one = _Found(*(c[best] for c in both), [ids[j] for j in best])
            held[int(number[start + i])] = one


def _searcher(k: int):
    """For each query of a task the k nearest classes over all lists that the task holds; ties by their smallest id, null last.

    Rows come by list, its vectors before its queries. A query's finds stand in memory, those of HELD queries at most; beyond it they
    are handed on early, and a query is then simply handed on twice."""
    keys = ("dim", "list", "chunk", "turn", "side")

    def handed(held: dict[int, _Found]) -> pa.RecordBatch:
        number = np.repeat(np.fromiter(held, np.int64, len(held)), [len(f.score) for f in held.values()])
        columns = [np.concatenate([getattr(f, c) for f in held.values()]) for c in ("rep", "score")]
        ids = pa.array([i for f in held.values() for i in f.ids], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(number), pa.array(columns[0]), ids, pa.array(columns[1])], names=["q", "rep", "ids", "score"])

    def run(batches):
        held: dict[int, _Found] = {}
        parts: list[pa.RecordBatch] = []
        current, listed = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(c).to_numpy() for c in keys])
            bounds = [0, *(np.flatnonzero(np.any(values[:, 1:] != values[:, :-1], axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(bounds, bounds[1:], strict=False):
                if current != (key := tuple(values[:-1, s])):
                    current, parts, listed = key, [], None
                if values[-1, s] == 0:
                    parts.append(batch.slice(s, e - s))
                elif parts:
                    listed = listed or _posting(parts)
                    _search(listed, batch.slice(s, e - s), held, k)
            if len(held) > HELD:
                yield handed(held)
                held = {}
        if held:
            yield handed(held)

    return run


def _fitted(classes: DataFrame, count: int) -> dict[int, Lists]:
    """Lists of each dimension, from a sample drawn by hash and bounded in numbers."""
    widest = classes.agg(F.max("dim")).first()[0] or 1
    rows = max(PER_LIST, min(SAMPLE_VALUES // widest, PER_LIST * math.ceil(count / LIST)))
    draw = F.xxhash64(F.lit(5), "h1", "h2")
    cut = min(2**63 - 1, int(2**64 * min(1.0, (1.1 * rows + 1000) / max(count, 1))) - 2**63)
    drawn = classes.where(draw <= F.lit(cut)).select("embedding", draw.alias("draw")).orderBy("draw").limit(rows).toArrow()
    sizes = np.diff(drawn.column("embedding").combine_chunks().offsets.to_numpy()) if drawn.num_rows else np.zeros(0, int)
    out = {}
    for dim in np.unique(sizes):
        mine = drawn.filter(pa.array(sizes == dim))
        expected = count * mine.num_rows / drawn.num_rows / LIST
        out[int(dim)] = build_lists(_matrix(mine.column("embedding"), mine.num_rows), int(min(expected, mine.num_rows / PER_LIST)))
    return out


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors(vec_id, embedding) where is_query holds its k nearest other rows."""
    spark, e = vectors.sparkSession, F.col("embedding")
    sound = e.isNotNull() & F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists(e, lambda v: v != 0)
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), e, F.coalesce(is_query & F.col("vec_id").isNotNull(), F.lit(False)).alias("asks"),
                                       F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2"))
    made = rows.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.max("asks").alias("asks"))
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("vec_id")))
    low = rows.select("h1", "h2", "vec_id", place.alias("place")).where(F.col("place") <= k + 1).groupBy("h1", "h2").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "vec_id"))), lambda s: s["vec_id"]).alias("ids"))
    classes = staged(made.join(low, ["h1", "h2"]).withColumns({"rep": F.monotonically_increasing_id(), "dim": F.size("embedding"), "first": F.element_at("ids", 1)}), "classes")
    lists = spark.sparkContext.broadcast(_fitted(classes, classes.count()))

    kind = vectors.schema["embedding"].dataType.simpleString()
    carried = ("dim", "embedding", "rep", "first", "ids")
    listed = classes.select(*carried).mapInArrow(_listing(lists, boundary_lists, carried), f"dim int, embedding {kind}, rep long, first long, ids array<long>, list int")
    asked = ("dim", "embedding", "q")
    asking = classes.where("asks").select("dim", "embedding", F.col("rep").alias("q")).mapInArrow(_listing(lists, searched_lists, asked), f"dim int, embedding {kind}, q long, list int")
    listed, asking = staged(listed, "listed"), staged(asking, "asking")
    here = listed.groupBy("dim", "list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).join(
        asking.groupBy("dim", "list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("turns")), ["dim", "list"])
    here = bounded_broadcast(staged(here, "lists"))
    keys = ("dim", "list", "chunk", "turn")

    def dealt(df: DataFrame, own: str, parts: str, number: str, other: str, others: str) -> DataFrame:
        return df.join(here, ["dim", "list"]).withColumn(own, F.pmod(F.xxhash64(number), F.col(parts)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop(parts, others)

    left = dealt(listed.withColumnRenamed("rep", "number"), "chunk", "chunks", "number", "turn", "turns")
    right = dealt(asking.withColumnRenamed("q", "number"), "turn", "turns", "number", "chunk", "chunks")
    columns = (*keys, "side", "number", "embedding", "first", "ids")
    right = right.withColumns({"side": F.lit(1), "first": F.lit(None).cast("long"), "ids": F.lit(None).cast("array<long>")})
    both = left.withColumn("side", F.lit(0)).select(*columns).unionByName(right.select(*columns))
    met = both.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(_searcher(k + 1), "q long, rep long, ids array<long>, score double")
    near = met.groupBy("q", "rep").agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
    entry = F.explode(F.transform("ids", lambda v: F.struct(F.col("score"), v.isNull().alias("none"), v.alias("vec_id"), F.col("rep")))).alias("entry")
    by_rep = Window.partitionBy("q").orderBy("score", F.asc_nulls_last(F.element_at("ids", 1)))
    entries = near.withColumn("n", F.row_number().over(by_rep)).where(F.col("n") <= k + 1).select("q", entry)
    found = entries.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("entry")), 1, k + 1).alias("found"))  # at most (k + 1) * (k + 1) a query
    found = staged(found.withColumnRenamed("q", "rep").join(classes.where("asks").select("rep", "h1", "h2"), "rep"), "found")

    out = rows.where("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2").join(found, ["h1", "h2"])
    own = F.array_position(F.transform("found", lambda s: (s["rep"] == F.col("rep")) & s["vec_id"].eqNullSafe(F.col("query_id"))), True).cast("int")
    rest = F.filter("found", lambda s, i: i + 1 != F.col("own"))
    ranked = out.withColumn("own", own).select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
