"""Near-duplicate embeddings by spherical-cap filters.

Filter directions form a random product code: each half of a direction is one of `k` random unit codewords, so
k*k directions need 2k inner products. A vector is list-decoded to all directions whose inner product with it
reaches the cap's threshold, vectors meet where they share (label, direction), and every meeting is verified by
cosine in double precision. k and the threshold follow from the number of rows of the largest label, so that a cap
holds about CAP vectors of a label whatever its size. Narrower caps are shared more rarely, so the number of directions
a vector is listed to (on average, and at least) grows with the logarithm of that number.

Equal vectors of one label form a class at once; one vector of a class goes on and counts for all. Caps with more
than CHUNK vectors are split into chunks that meet pairwise in separate tasks. A pair that meets in several caps is counted in the
one of the smallest number, which each side finds from the numbers of its own smaller caps. Where vectors meet, no pair
is written: a meeting gives for each vector how many it links to there, and for each connected part of its links one edge from its
first vector to each other one. So the rows grow with vectors and caps, also in a large group of near copies.

Vectors without label, null, zero, or with null or non-finite components link with nothing. Each row counts as a vector,
repeated ones and those of a null or shared vec_id too; the smallest vec_id of a group passes over nulls. An empty table gives no
rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_broadcast, components, staged

CAP = 12
LISTED = 32  # in labels of up to ROWS vectors
ROWS = 9000
STEP = 10  # more for each doubling
CHUNK = 1500


def code(dim: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of the two halves of the directions."""
    rng = np.random.default_rng([seed, dim, k])
    halves = []
    for d in (dim - dim // 2, dim // 2):
        c = rng.standard_normal((k, max(d, 1)))
        halves.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return halves[0], halves[1]


def decode(x: np.ndarray, halves: tuple[np.ndarray, np.ndarray], threshold: float, least: int = LISTED) -> list[np.ndarray]:
    """For each unit row of x the numbers of all directions whose inner product reaches the threshold, `least` at least."""
    k, cut = len(halves[0]), x.shape[1] - x.shape[1] // 2
    a = x[:, :cut] @ halves[0].T / math.sqrt(2)
    b = x[:, cut:] @ halves[1].T / math.sqrt(2) if x.shape[1] > 1 else np.zeros((len(x), k))
    out = []
    for u, v in zip(a, b, strict=True):
        i, j = np.flatnonzero(u >= threshold - v.max()), np.flatnonzero(v >= threshold - u.max())
        hit = np.argwhere(u[i][:, None] + v[j][None, :] >= threshold)
        found = i[hit[:, 0]] * k + j[hit[:, 1]]
        if len(found) < least:
            top = min(k, least)  # the best sums lie among the best codewords of both halves
            i, j = np.argsort(-u)[:top], np.argsort(-v)[:top]
            s = u[i][:, None] + v[j][None, :]
            best = np.argsort(-s, axis=None)[:least]
            found = i[best // top] * k + j[best % top]
        out.append(found)
    return out


def caps(largest: int, cap: int = CAP) -> tuple[int, float, int]:
    """Codewords of a half, threshold in deviations of an inner product, and directions listed at least, for labels of up to `largest` vectors."""
    listed = LISTED + math.ceil(STEP * math.log2(max(1.0, largest / ROWS)))
    share = min(0.2, cap / largest)
    return max(4, math.ceil(math.sqrt(listed / share))), NormalDist().inv_cdf(1 - share), listed


def _matrix(col, n: int) -> np.ndarray:
    flat = col.flatten() if hasattr(col, "flatten") else col.values
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is divided out first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unshared(i: np.ndarray, j: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Whether the lists of rows i and j have nothing in common, for each pair."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    values = np.concatenate([lists[r] for r in rows])
    caps, where, n = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [len(lists[r]) for r in rows])
    often = n > 1
    column = np.cumsum(often) - 1
    keep = often[where]
    owner, where = owner[keep], column[where[keep]]
    shared = np.zeros((len(rows), len(rows)), dtype=bool)
    for start in range(0, int(often.sum()), 1024):  # a block of caps at a time
        block = (where >= start) & (where < start + 1024)
        has = np.zeros((len(rows), 1024), dtype=np.float32)
        has[owner[block], where[block] - start] = 1
        shared |= has @ has.T > 0
    return ~shared[at[: len(i)], at[len(i) :]]


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the first one it is connected to by the edges (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if np.array_equal(root, before):
            return root


def _meeting(rows: pa.RecordBatch, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the vectors of one (label, dim, cap, chunks) meeting give: vectors and the links counted there, edges (a, b)."""
    rep, side, copies = (rows.column(k).to_numpy() for k in ("rep", "side", "copies"))
    x = _unit(_matrix(rows.column("embedding"), rows.num_rows))
    left = np.flatnonzero(side == 0)
    right = left if len(left) == len(side) else np.flatnonzero(side == 1)
    i, j = np.nonzero(x[left] @ x[right].T >= least)
    i, j = left[i], right[j]
    if right is left:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return (rep[:0],) * 4
    lists = rows.column("smaller")
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    owned = _unshared(i, j, [values[a:b] for a, b in zip(ends, ends[1:], strict=False)])
    links = np.bincount(i[owned], copies[j[owned]], len(rep)) + np.bincount(j[owned], copies[i[owned]], len(rep))
    some, root = np.flatnonzero(links), _roots(i, j, len(rep))
    tied = np.flatnonzero(root != np.arange(len(rep)))
    return rep[some], links[some].astype(np.int64), rep[root[tied]], rep[tied]


def _meet(least: float):
    def run(batches):
        kept: list[pa.RecordBatch] = []

        def close():
            if sum(b.num_rows for b in kept) < 2:
                return None
            rep, links, a, b = _meeting(pa.Table.from_batches(kept).combine_chunks().to_batches()[0], least)
            if not len(a) and not len(rep):
                return None
            edges = pa.array(np.concatenate([rep, b])), pa.array(np.concatenate([np.zeros(len(rep), np.int64), a]), mask=np.arange(len(rep) + len(a)) < len(rep))
            return pa.RecordBatch.from_arrays([*edges, pa.array(np.concatenate([links, np.zeros(len(a), np.int64)]))], names=["rep", "root", "links"])

        keys, current = ("label", "dim", "cap", "lo", "hi"), None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy() for k in keys])
            starts = np.flatnonzero(np.any(values[:, 1:] != values[:, :-1], axis=0)) + 1
            bounds = [0, *starts.tolist(), batch.num_rows]
            for s, e in zip(bounds, bounds[1:], strict=False):
                key = tuple(values[:, s])
                if kept and key != current:
                    if (out := close()) is not None:
                        yield out
                    kept.clear()
                current = key
                kept.append(batch.slice(s, e - s))
        if (out := close()) is not None:
            yield out

    return run


def meetings(vectors: DataFrame, least: float = 0.93, cap: int = CAP) -> DataFrame:
    """From vectors(rep long, label long, dim int, embedding, copies long): rows (rep, null, links to other vectors, copies counted) and
    (rep, root, 0), an edge of the graph of links. A rep has several rows of links, to be summed."""
    largest = vectors.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    k, z, listed = caps(largest, cap)
    number = (pa.int32(), "int") if k * k < 1 << 31 else (pa.int64(), "long")
    carried = ("rep", "label", "dim", "embedding", "copies")

    def lists(batches):
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # codewords of each length, once a task
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                of_dim = batch.filter(pa.array(dims == dim))
                for start in range(0, of_dim.num_rows, 256):
                    rows = of_dim.slice(start, 256)
                    x = _unit(_matrix(rows.column("embedding"), rows.num_rows))
                    halves = drawn.get(int(dim)) or drawn.setdefault(int(dim), code(int(dim), k))
                    found = [np.sort(f) for f in decode(x, halves, z / math.sqrt(dim), listed)]
                    at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                    before = np.concatenate([np.arange(len(f)) for f in found])  # how many caps of smaller number each cap's row names
                    smaller = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(before)]).astype(np.int32)),
                                                       pa.array(np.concatenate([f[np.tril_indices(len(f), -1)[1]] for f in found]), number[0]))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c).take(at) for c in carried), pa.array(np.concatenate(found)), smaller],
                                                     names=[*carried, "cap", "smaller"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    members = vectors.select(*carried).mapInArrow(
        lists, f"rep long, label long, dim int, embedding {kind}, copies long, cap long, smaller array<{number[1]}>")
    sizes = members.groupBy("label", "dim", "cap").agg(F.count("*").alias("n"))
    large = bounded_broadcast(staged(sizes.where(F.col("n") > CHUNK), "caps"))
    chunks = F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int")
    own = members.join(large, ["label", "dim", "cap"], "left").withColumn("chunks", chunks).withColumn(
        "own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    meets = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "label", "dim", "cap", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "rep", "embedding", "copies", "smaller")
    dealt = meets.repartition("label", "dim", "cap", "lo", "hi").sortWithinPartitions("label", "dim", "cap", "lo", "hi")
    return dealt.mapInArrow(_meet(least), "rep long, root long, links long")


def embedding_groups(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    sound = F.col("label").isNotNull() & e.isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label", F.coalesce(sound, F.lit(False)).alias("ok"))
    key = lambda seed: F.when(F.col("ok"), F.xxhash64(F.lit(seed), "label", "embedding"))
    keyed = rows.withColumns({"h1": key(1), "h2": key(2)})
    label = F.col("label").cast("long") if isinstance(vectors.schema["label"].dataType, T.IntegralType) else F.xxhash64("label")
    made = keyed.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first(label).alias("label"))
    classes = staged(made.withColumn("rep", F.monotonically_increasing_id()), "classes")  # the numbers hold once written
    met = staged(meetings(classes.select("rep", "label", F.size("embedding").alias("dim"), "embedding", "copies"), least), "meetings")
    degree = met.where("root is null").groupBy("rep").agg(F.sum("links").alias("others"))
    group = components(met.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    known = staged(classes.select("h1", "h2", "vec_id", "copies", "rep").join(degree, "rep", "left").join(group, "rep", "left").select(
        "h1", "h2", "vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c")), "groups")
    known = known.join(known.groupBy("c").agg(F.min("vec_id").alias("component_id")), "c").select("h1", "h2", "n_links", "component_id")
    out = keyed.select("vec_id", "ok", "h1", "h2").join(known, ["h1", "h2"], "left")
    comp = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("ok"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      comp.alias("component_id"), comp.eqNullSafe(F.col("vec_id")).alias("kept"))
