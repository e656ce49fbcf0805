"""Sharding by a two-pass external shuffle.

Pass one counts bytes and scatters whole records by seeded hashes into buckets of at most BUCKET_BYTES on
average; pass two shuffles each bucket in one task with a seeded Fisher-Yates permutation. A bucket
belongs to one shard, so bucket offsets plus positions give gapless slots in each shard.

The law is `key`: the shard is the rendezvous-hash winner of the document's id among the shards, so one more
shard takes rows only into itself. Rows that share an id share a shard, but not a bucket: the bucket hashes the whole record, so
many records of one id (or of none) spread over the shard's buckets. Records equal in every column are interchangeable and
share a bucket. A null id hashes like any other value; a null text has no bytes. An empty table gives an empty result. Within a
bucket records are put in order of their hashes before they are permuted, so that a task run again gives the same slots.
Columns are kept whatever their names; the helpers' own ones get other names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_broadcast, free_name, staged

SEED = 20240607
BUCKET_BYTES = 48 << 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard with the largest hash of (seed, shard, key)."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))["s"]


def _permute(seed: int, order: str, pos: str):
    def shuffle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard, bucket = (k.as_py() for k in key)
        at = pa.compute.sort_indices(rows.column(order))
        n = rows.num_rows
        at = at.take(pa.array(np.random.default_rng([seed, shard, bucket]).permutation(n)))  # Fisher-Yates
        return rows.take(at).append_column(pos, pa.array(np.arange(n, dtype=np.int64)))

    return shuffle


def shuffle_into_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = SEED,
                        bucket_bytes: int = BUCKET_BYTES, into: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """All columns of docs plus two: shard int and slot long (gapless from 0 in each shard), named by `into`."""
    if taken := {c.lower() for c in docs.columns} & {c.lower() for c in into}:
        raise ValueError(f"docs has columns named {sorted(taken)}; choose other names by `into`")
    shard, slot = into
    bucket, order, pos, start = (free_name(docs, c) for c in ("_bucket", "_order", "_pos", "_from"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)).first()[0] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    record = F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text), *docs.columns)
    placed = docs.withColumns({order: record, shard: shard_of(F.col(key), shards, seed), bucket: F.pmod(record, F.lit(buckets)).cast("int")})
    counts = staged(placed.groupBy(shard, bucket).agg(F.count("*").alias("n")), "buckets")
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    schema = T.StructType([*placed.schema.fields, T.StructField(pos, T.LongType())])
    mixed = placed.groupBy(shard, bucket).applyInArrow(_permute(seed, order, pos), schema)
    return mixed.join(bounded_broadcast(offsets), [shard, bucket]).select(*docs.columns, shard, (F.col(start) + F.col(pos)).alias(slot))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled records as parquet, a folder for each shard, ordered by slot within its files."""
    shard, slot = options.get("into", ("shard", "slot"))
    shuffle_into_shards(docs, **options).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def shard_digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    out = shuffle_into_shards(docs.select("doc_id", "text"), shards)
    return out.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                      F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"),
                      "shard", "slot",
                      shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
