"""Micro-batch jobs that keep keyed tables: ingest, refresh of changed keys, late corrections.

What a key needs of earlier batches stands in a keyed state store. A batch writes only the folder of its number, so one that is run again replaces its own rows."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from tidemark.operators import writes


def _run(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def _table(spark, folder: str, schema) -> DataFrame:
    """All batches so far, with their number."""
    full = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("int")).schema
    return spark.read.schema(full).option("basePath", folder).parquet(folder)


@contextmanager
def _rocks(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, so that it need not fit the heap; each batch writes only what changed."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest_once(items: DataFrame, folder: str, key: str, order: str, enrich: Callable[[DataFrame], DataFrame] = lambda d: d, late: str = "30 days") -> DataFrame:
    """The enriched rows of a stream, each key once, in the form in which it came first.

    Seen keys stand in a keyed state store until the watermark is `late` past them, so no batch reads the rows kept so far. A row more than
    `late` behind the newest time of the batches before goes, as does one without key or time. Of rows of a key
    in one batch any may be the one; they are taken to be copies."""
    out, schema = f"{folder}/items", enrich(items).schema
    fresh = items.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withWatermark(order, late).dropDuplicatesWithinWatermark([key])
    with _rocks(items.sparkSession):
        _run(fresh, folder, lambda batch, number: enrich(batch).write.mode("overwrite").parquet(f"{out}/batch={number}"))
    return _table(items.sparkSession, out, schema).drop("batch")


def refresh_latest(items: DataFrame, folder: str, keys: list[str], values: list[str], order: list[str], limit: int = 32) -> DataFrame:
    """keys, the means of `values` over the latest `limit` items of a key, used (how many those are) and total (all items of the key), after all files there are now.

    A key's state is its latest `limit` items, as order (a time, then a string) and values, and the number of all. So a batch
    costs what it brings, whatever came before. Before the shuffle each task keeps of a key only its latest items with their number, so a key
    that holds much of a batch stays small. Null values don't count in a mean; null times are the oldest. Rows with a null key go."""
    spark, out, n = items.sparkSession, f"{folder}/summary", len(values)
    at, tie = order
    rows = items.dropna(subset=keys).select(*keys, F.coalesce(F.unix_micros(at), F.lit(-(1 << 63))).alias("_at"), F.coalesce(F.col(tie).cast("string"), F.lit("")).alias("_id"),
                                            *[F.col(c).cast("double").alias(c) for c in values], F.lit(1).cast("long").alias("_n"))

    def newest(batches):
        for b in batches:
            top = b.sort_values(["_at", "_id"], ascending=False, kind="stable").groupby(keys, sort=False)
            kept, size, place = top.head(limit), top["_n"].transform("size"), top.cumcount()
            yield kept.assign(_n=size.where(place == 0, 0).loc[kept.index])

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    shown = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = ", ".join([shown, *(f"`{c}` double" for c in values), "used long, total long"])

    def fold(key, batches, state):
        times, ids, numbers, total = state.get if state.exists else ([], [], [], 0)
        held = [(t, i, tuple(numbers[j * n : j * n + n])) for j, (t, i) in enumerate(zip(times, ids, strict=True))]
        for b in batches:
            total += int(b["_n"].sum())
            held = heapq.nlargest(limit, [*held, *zip(b["_at"].tolist(), b["_id"].tolist(), map(tuple, b[values].to_numpy()), strict=True)], key=lambda h: h[:2])
        state.update(([h[0] for h in held], [h[1] for h in held], [float(v) for h in held for v in h[2]], total))
        table = np.array([h[2] for h in held], dtype=float).reshape(-1, n)
        means = [None if np.isnan(c).all() else float(np.nanmean(c)) for c in table.T]
        yield pd.DataFrame([[*key, *means, len(held), total]], columns=[*keys, *values, "used", "total"])

    packed = rows.mapInPandas(newest, ", ".join([shown, "_at long, _id string", *(f"`{c}` double" for c in values), "_n long"]))
    summed = packed.groupBy(*keys).applyInPandasWithState(fold, schema, "at array<long>, ids array<string>, numbers array<double>, total long", "update", GroupStateTimeout.NoTimeout)
    with _rocks(spark):
        _run(summed, folder, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), "update")
    return latest(_table(spark, out, summed.schema), keys, [F.col("batch").desc()]).drop("batch")


def stream_ingest(items: DataFrame, folder: str, key: str, order: str, enrich: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """The enriched rows of a stream, each key once: the first by order within its first batch. No state is held, so no row is too late, but each batch reads the kept keys; ingest_once does not."""
    out, schema = f"{folder}/items", enrich(items).schema

    def write(batch: DataFrame, number: int) -> None:
        new = writes.dedup_by_key(batch.where(F.col(key).isNotNull()), [key], [order])
        if number > 0:
            new = writes.insert_new(_table(batch.sparkSession, out, schema).where(F.col("batch") < number), new, [key])
        enrich(new).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(items, folder, write)
    return _table(items.sparkSession, out, schema).drop("batch")


def stream_refresh(items: DataFrame, folder: str, keys: list[str], summary: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """summary(items) by keys, kept up to date: each batch computes again the keys it touches, from all their items so far.

    For summaries of any kind; means over the latest items come cheaper from refresh_latest, which reads no earlier item."""
    spark, kept, out = items.sparkSession, f"{folder}/items", f"{folder}/summary"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        so_far = _table(batch.sparkSession, kept, items.schema).where(F.col("batch") <= number).drop("batch")
        touched = batch.select(*keys).distinct()
        summary(so_far.join(touched, keys, "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(items, folder, write)
    schema = summary(spark.createDataFrame([], items.schema)).schema
    return latest(_table(spark, out, schema), keys, [F.col("batch").desc()]).drop("batch")


def late_bars(bars: DataFrame, folder: str, revision: str) -> DataFrame:
    """Bars of a stream by (symbol, date), the highest revision winning, whichever batch brought it."""
    _run(bars, folder, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/bars/batch={number}"))
    kept = _table(bars.sparkSession, f"{folder}/bars", bars.schema)
    return latest(kept, ["symbol", "date"], [F.col(revision).desc(), F.col("batch").desc()]).drop("batch")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
