"""Near-duplicate documents by b-bit MinHash.

Words are runs of other characters than ASCII white space, A-Z lower-cased; a document's set holds its
distinct shingles of five words (fewer words: the whole sequence). Documents with equal sets form a class at
once. One row per class goes on: PERMS minima, of which BANDS keys of ROWS minima each give candidates, and
the low BITS bits of every minimum are kept as bit planes, packed into 64-bit words. A candidate pair is
estimated from the number of agreeing positions (bit counts of the planes' differences, corrected for chance
agreement), and what the estimate doesn't exclude by a wide margin is confirmed on the full sets.

Links come in two rounds, so that a large group isn't paired up: first every member of a bucket with the
bucket's hub; then, after components are known, those that share a bucket across components are joined on the
rarest shingles of their full sets. Links inside a component can't change the result.

Documents without words or text have an empty set and are linked with nothing. Repeated rows are one class. A class is known by
the number of one of its rows in the written sketches, not by a doc_id, so rows of a null or shared doc_id are grouped each by
its own text. The smallest doc_id of a group passes over nulls; a group of nulls alone has a null component_id. An
empty table gives no rows, and a text of any length is taken whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import KEPT_WORD, bounded_broadcast, components, free_name, staged

WORDS = 5
BANDS, ROWS, BITS = 32, 5, 4  # at similarity 0.8 no band agrees in 3 of a million pairs
PERMS = BANDS * ROWS
PLANE = -(-PERMS // 64)
#: A pair is dropped before its confirmation only if its estimate is this far (about five deviations) below the limit.
MARGIN = 0.16
_rng = np.random.default_rng(90210)
_MULT = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_A = (_rng.integers(1, 1 << 32, PERMS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_WORD:  # it only saves work
            if len(self) > 60_000:
                self.clear()
            self[word] = h
        return h


_word_hash = _WordHash()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - WORDS + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words))], dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        out += h[k : k + n] * _MULT[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(PERMS, 0xFFFFFFFF, dtype=np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(low, (h[i : i + 1024, None] * _A + _B).min(axis=0), out=low)
    return low


def _sketch(batches):
    row = TaskContext.get().partitionId() << 40  # numbers of this partition's rows; they count once written
    spread = np.random.default_rng(5).integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
    lane = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        ids, n, h1, h2, bands, planes = [], [], [], [], [], []
        rows = np.arange(row, row + batch.num_rows)
        row += batch.num_rows
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = shingle_set(text.as_py())
            ids.append(doc_id)
            n.append(len(s))
            if not len(s):
                h1.append(None)
                h2.append(None)
                bands.append(None)
                planes.append(None)
                continue
            for out, h in zip((h1, h2), _digest(s), strict=True):
                out.append(h)
            low = minima(s)
            key = (low.reshape(BANDS, ROWS).astype(np.uint64) * spread).sum(axis=1, dtype=np.uint64) + lane
            key ^= key >> np.uint64(31)
            key *= np.uint64(0x94D049BB133111EB)
            bands.append(key.view(np.int64).tolist())
            bits = np.zeros((BITS, PLANE * 64), dtype=np.uint8)
            bits[:, :PERMS] = (low[None, :] >> np.arange(BITS, dtype=np.uint32)[:, None]) & 1
            planes.append(np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel().tolist())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                                          pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))],
                                         names=["row", "doc_id", "n_shingles", "h1", "h2", "bands", "planes"])


def sketches(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _sketch, "row long, doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, planes array<long>")


def estimate(x, y):
    """Similarity from packed low bits: share of agreeing positions, corrected for agreement by chance."""
    differ = F.lit(0)
    for w in range(PLANE):
        planes = [x[p * PLANE + w].bitwiseXOR(y[p * PLANE + w]) for p in range(BITS)]
        word = planes[0]
        for p in planes[1:]:
            word = word.bitwiseOR(p)
        differ = differ + F.bit_count(word)
    chance = 0.5**BITS
    return ((1 - differ / PERMS) - chance) / (1 - chance)


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles sorted array<long>) of the classes in wanted(id, doc_id, h1, h2), written.

    Texts are found by doc_id, nulls too, and told apart by the digest of their sets."""
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(bounded_broadcast(ids), F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def sets(batches):
        for b in batches:
            full = [shingle_set(t.as_py()) for t in b.column(0)]
            keys = np.array([_digest(s) for s in full], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([np.sort(s.view(np.int64)) for s in full], pa.list_(pa.int64()))],
                                             names=["h1", "h2", "shingles"])

    made = texts.select("text").mapInArrow(sets, "h1 long, h2 long, shingles array<long>")
    found = made.join(bounded_broadcast(wanted.select("h1", "h2", "id")), ["h1", "h2"])
    return staged(found.select("id", "shingles").dropDuplicates(["id"]), "sets")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets reach the limit: 100 * shared >= percent * all."""
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        full.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def check(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf.sa, pdf.sb, strict=True):
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pd.DataFrame({"a": pdf.a[keep], "b": pdf.b[keep]})

    return both.mapInPandas(check, "a long, b long")


def _prefix_pairs(full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of full(id, c, shingles) from different components c that may reach the limit.

    Each set is ordered by rarity. Two sets over the limit share a shingle among the first few of both (the prefix), and at the first
    such place enough of both must be left. What is common to many documents comes last, so it makes no pairs."""
    token = full.select("id", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    often = token.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    mine = Window.partitionBy("id")
    shared = token.join(often, "t").withColumns({"r": F.row_number().over(mine.orderBy("f", "t")), "k": F.count("*").over(mine)})
    # Shingles that no other set has stand before all others.
    place = shared.select("id", "c", "n", "t", (F.col("n") - F.col("k") + F.col("r")).alias("at")).where(
        F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    x = place.select("t", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("at").alias("pa"))
    y = place.select("t", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    left = (1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return x.join(y, (x["t"] == y["t"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits & left).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest linked doc_id), kept."""
    made = staged(sketches(docs), "sketches")
    filled = made.where("n_shingles > 0")
    classes = staged(filled.groupBy("h1", "h2").agg(F.min_by("row", F.coalesce("doc_id", F.lit(1 << 62))).alias("id"), F.min("doc_id").alias("doc_id")), "classes")
    first = staged(filled.select(F.col("row").alias("id"), "bands", "planes").join(classes.select("id"), "id", "left_semi"), "reps")
    member = first.select("id", F.explode("bands").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = staged(member.join(sizes, "key"), "members")
    # The hub of a bucket is the member that meets most others over all its buckets: of near copies, the text they come from.
    weight = crowded.groupBy("id").agg(F.sum("n").alias("w"))
    hubs = crowded.join(weight, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("d"))).alias("best"))
    inside = staged(crowded.join(hubs, "key").select("key", (-F.col("best.d")).alias("hub"), "id"), "buckets")

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        side = first.select("id", "planes")
        seen = pairs.join(side.select(F.col("id").alias("a"), F.col("planes").alias("pa")), "a").join(
            side.select(F.col("id").alias("b"), F.col("planes").alias("pb")), "b")
        return staged(seen.where(estimate(F.col("pa"), F.col("pb")) >= percent / 100 - MARGIN).select("a", "b"), name)

    to_hub = likely(inside.where("id != hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct(), "candidates")
    wanted = to_hub.select(F.col("a").alias("id")).union(to_hub.select("b")).distinct()
    links = staged(_confirmed(to_hub, _full_sets(docs, staged(classes.join(wanted, "id"), "wanted")), percent), "links")
    group = components(links)
    # Second round: members of a bucket that are still apart.
    now = inside.join(group.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = now.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    apart = staged(now.join(mixed, "key").select("id", "c").distinct().join(classes, "id"), "apart")
    full = _full_sets(docs, apart)
    more = staged(_confirmed(_prefix_pairs(full.join(apart.select("id", "c"), "id"), percent), full, percent), "links")
    group = components(links.unionByName(more))
    grouped = staged(classes.join(group.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", "doc_id", F.coalesce("component", "id").alias("c")), "groups")
    smallest = grouped.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    known = grouped.select("h1", "h2", "c").join(smallest, "c").select("h1", "h2", "component_id")
    out = made.select("doc_id", "n_shingles", "h1", "h2").join(known, ["h1", "h2"], "left")
    comp = F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), comp.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_first_of_groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the rows of documents that another document of their group stands for.

    Each row is decided on its own text, also where a doc_id is null or shared by different texts; of a group the row with the
    smallest doc_id (nulls last) stays. Rows of an empty set go only if they repeat the text and non-null doc_id of another."""
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").limit(1).count()
    if shared:
        return _first_rows(docs, percent)
    name = free_name(docs, "_dropped")
    dropped = staged(near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias(name)), "dropped")
    return docs.join(bounded_broadcast(dropped), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def _first_rows(docs: DataFrame, percent: int) -> DataFrame:
    """One row of each group of rows, where doc_id does not tell rows apart: they get numbers, which are written."""
    row = free_name(docs, "_row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    made = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), percent)
    groups = made.select(F.col("doc_id").alias("row"), (F.col("n_shingles") == 0).alias("empty"), "component_id")
    empty = lambda c: F.when(F.col("empty"), c)
    same = [F.when(~F.col("empty"), F.col("component_id")).alias("group"), empty(F.col("doc_id")).alias("id"), empty(F.col("content")).alias("content"),
            empty(F.when(F.col("doc_id").isNull(), F.col("row"))).alias("alone")]
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), F.col(row).alias("row"))
    first = rows.select(F.col(row).alias("row"), "doc_id", F.xxhash64("text").alias("content"), order.alias("order")).join(groups, "row").groupBy(*same).agg(
        F.min("order").alias("first"))
    first = staged(first.select(F.col("first.row").alias(row)), "first")
    return rows.join(first, row, "left_semi").select(*docs.columns)
