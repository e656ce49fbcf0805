"""Helpers shared by the training-data operators: staged tables, bounded broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 2_000_000
#: Rows of an Arrow batch while a staged table is written.
BATCH_ROWS = 1000
#: Words up to this length may be kept in a worker's table of known words; longer ones are worked out each time, so its bytes are bounded.
KEPT_WORD = 64
_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster that is an error."""
    global _own_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dir


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = conf.get(key)
    conf.set(key, min(int(rows), BATCH_ROWS))  # long texts: smaller batches for Python
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.set(key, rows)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within the bound, else df as it is."""
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df


def held_out(col, folds: int, fold: int):
    """Whether crc32(id as text) mod folds is fold."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % folds) == fold


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(a long, b long): (node, component), component the smallest node.

    Alternates large-star and small-star steps; each is a min-aggregation and an equi-join (skewed
    nodes are split by adaptive execution), and each round is staged. Ends when a round changes nothing.
    """
    cur = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def mark(df):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(cur)
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        cur = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        after = mark(cur)
        if after == before:
            break
        before = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
