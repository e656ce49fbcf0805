"""Which filter removes what: five text filters applied in all orders, kept up by retraction over micro-batches.

The files of a documents table are processed as available-now micro-batches. A batch is reduced by Spark to the
holders of each text (by SHA-256 of the text): where the rows of the smallest doc_id of a text stand and how many they
are. The state is one small row per text and holder of its smallest id, staged by batch in the shared folder; it holds
no text. When a batch brings a smaller id for a text, its earlier holders are retracted from the counters of their part
and mask, and the new ones are added: ids that come in any order give the same counters. A batch writes only the
folders of its number, so one that is run again replaces its own rows, and a restart goes on at the last batch.

From the counters (part, mask of failed filters) follow all orders: a document is removed by the first filter of an
order that it fails, and of all orders each of its k failed filters stands first in 120 / k.

Filters: A under 200 words; B 100 * distinct words < 50 * words; C 100 * `[A-Z]` characters > 2 * code points;
D holds any of `#$%&*|`; E identical to the text of a smaller doc_id anywhere. A null text is empty, a null source an
empty part. A row of null doc_id has no smaller id and is none: it never fails E and makes none fail it. Rows that
share doc_id and text pass or fail E together. A document counts as quality=1 (toxic=1) if any row of labels with its
doc_id says so. Further columns, of any name, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir

FILTERS = "ABCDE"
#: Micro-batches that a table is dealt to.
BATCHES = 4
#: Rows of null doc_id are spread over so many values where labels are joined.
SALTS = 1024
_LAST = 1 << (len(FILTERS) - 1)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, from bit 0."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 200, F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(50).cast("long"),
             capitals * F.lit(100).cast("long") > F.length(text) * F.lit(2).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(fail, 1 << bit).otherwise(0) for bit, fail in enumerate(fails)), F.lit(0))


def _holders(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, part, mask, quality, toxic, n, id, at_id): rows of a text with these marks, their smallest doc_id and how many hold it."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("key"),
                       F.coalesce("source", F.lit("")).alias("part"), text_mask(text).alias("mask"))
    once = rows.groupBy("id", "key", "part", "mask").agg(F.count("*").alias("n"))
    once = once.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("key", "part"), F.lit(SALTS)) + 1).otherwise(0))
    said = labels.select(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("salt"), *(
        F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in ("quality", "toxic")))
    said = said.where("id is not null and (quality or toxic)").groupBy("id", "salt").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = once.join(said, ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})
    # a null id is larger than any other here, so only groups without an id have none
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("n").alias("at_id")))
    out = known.groupBy("key", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free"), first.alias("first"))
    return out.select("key", "part", "mask", "quality", "toxic", "n", "free", F.col("first.id").alias("id"), F.col("first.at_id").alias("at_id"))


_STATE = "key binary, part string, mask int, quality boolean, toxic boolean, id long, at_id long, batch int"
_COUNTS = "part string, mask int, quality boolean, toxic boolean, n long, passing long, batch int"


def _before(spark: SparkSession, folder: str, schema: str, number: int) -> DataFrame:
    if number == 0:
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/batch={b}" for b in range(number)))


def take_batch(batch: DataFrame, labels: DataFrame, folder: str, number: int) -> None:
    """Takes one micro-batch: writes the state rows it brings and what it changes in the counters, retractions below zero."""
    spark = batch.sparkSession
    marks = ("part", "mask", "quality", "toxic")
    path = f"{folder}/holders/batch={number}"
    _holders(batch, labels).write.mode("overwrite").parquet(path)
    new = spark.read.parquet(path)
    old = _before(spark, f"{folder}/state", _STATE, number)
    both = old.select("key", *marks, "id", "at_id", F.lit(True).alias("old")).unionByName(
        new.where("id is not null").select("key", *marks, "id", "at_id", F.lit(False).alias("old")))
    least = both.groupBy("key").agg(F.min("id").alias("least"), F.min(F.when(F.col("old"), F.col("id"))).alias("was"))
    met = both.join(least, "key")
    brought = met.where("not old and id = least").select("key", *marks, "id", "at_id")
    brought.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
    added = spark.read.schema(brought.schema).parquet(f"{folder}/state/batch={number}").select(*marks, F.col("at_id").alias("passing"))
    retracted = met.where("old and id = was and least < was").select(*marks, (-F.col("at_id")).alias("passing"))
    free = new.where("free > 0").select(*marks, F.col("free").alias("passing"))
    zero = F.lit(0).cast("long")
    changes = new.select(*marks, "n", zero.alias("passing")).unionByName(
        added.unionByName(retracted).unionByName(free).withColumn("n", zero))
    changes.groupBy(*marks).agg(F.sum("n").alias("n"), F.sum("passing").alias("passing")).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")


def count_masks(stream: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """(part, mask, quality, toxic, n): documents of a stream by the filters they fail, after all files that are there now."""
    spark = stream.sparkSession
    (stream.writeStream.foreachBatch(lambda batch, number: take_batch(batch, labels, folder, number))
     .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination())
    marks = ("part", "mask", "quality", "toxic")
    try:
        found = spark.read.schema(_COUNTS).option("basePath", f"{folder}/counters").parquet(f"{folder}/counters")
    except Exception as none:  # no file, so no batch
        if "PATH_NOT_FOUND" not in str(none):
            raise
        found = spark.createDataFrame([], T._parse_datatype_string(_COUNTS))
    sums = found.groupBy(*marks).agg(F.sum("n").alias("n"), F.sum("passing").alias("passing"))
    kind = F.explode(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")),
                             F.struct((F.col("mask") + _LAST).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    return sums.select("part", "quality", "toxic", kind.alias("k")).select("part", "k.mask", "quality", "toxic", "k.n").where("n > 0")


def interactions(masks: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from rows (part, mask, quality, toxic, n)."""
    size = 1 << len(FILTERS)

    def counts(which: Column) -> Column:
        return F.array(*(F.sum(F.when(which & (F.col("mask") == m), F.col("n")).otherwise(0)) for m in range(size)))

    parts = masks.groupBy("part").agg(counts(F.lit(True)).alias("every"), counts(F.col("quality")).alias("good"), counts(F.col("toxic")).alias("bad"))
    orders = [(''.join(order), step + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in order[:step]))
              for order in permutations(FILTERS) for step, f in enumerate(order)]
    steps = masks.sparkSession.createDataFrame(orders, "filter_order string, step int, bit int, before int")
    rows = parts.crossJoin(F.broadcast(steps))  # 600 rows a part, which is the result
    bit, before, every = F.col("bit"), F.col("before"), F.arrays_zip(F.sequence(F.lit(0), F.lit(size - 1)).alias("mask"), "every", "good", "bad")

    def total(what: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(where(c["mask"]), c[what]).otherwise(0))

    def removed(m):
        return (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)

    ways = math.factorial(len(FILTERS))
    shapley = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(
        c["mask"].bitwiseAND(bit) != 0, c["every"] * (F.lit(ways) / F.bit_count(c["mask"])).cast("long")).otherwise(0))
    return rows.withColumn("cells", every).select(
        "part", "filter_order", "step",
        total("every", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total("every", removed).alias("removed"),
        total("every", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"),
        total("every", lambda m: m == bit).alias("unique_fails"), total("good", removed).alias("good_lost"),
        total("bad", removed).alias("toxic_lost"), shapley.alias("shapley"))


def audit_filters(spark: SparkSession, documents: str, labels: DataFrame, batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """The audit of the Parquet table in the folder (or file) `documents`, read as `batches` micro-batches at most.

    With a folder of an earlier run given, only files that came since are read."""
    table = spark.read.parquet(documents)
    files = table.inputFiles()
    path = documents.rstrip("/")
    if len(files) == 1 and files[0].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]:
        path = f"{path[:-1]}[{path[-1]}]"  # streams read a single file only by a pattern
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, math.ceil(len(files) / batches))).parquet(path)
    return interactions(count_masks(stream, labels, folder or f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"))


ORACLE_SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
 orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
 steps AS (SELECT o, s::INT AS s, substr(o, s::INT, 1) AS f FROM orders, range(1, 6) r(s)),
 said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
 d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
 w AS (SELECT d.*, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM d),
 m AS (SELECT part, coalesce(q, 0) AS q, coalesce(t, 0) AS t, (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) ||
   (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END) ||
   (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 'C' ELSE '' END) ||
   (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN coalesce(w.doc_id > least, false) THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN said ON said.doc_id = w.doc_id),
 c AS (SELECT part, q, t, fails, count(*) AS n FROM m GROUP BY ALL),
 r AS (SELECT part, o, s, f, n, q, t, fails, contains(fails, f) AS hit, translate(fails, substr(o, 1, s - 1), '') <> fails AS gone FROM c, steps),
 g AS (SELECT part, o AS filter_order, s AS step, f, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
   sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
   sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN n * q ELSE 0 END)::BIGINT AS good_lost,
   sum(CASE WHEN hit AND NOT gone THEN n * t ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
"""
