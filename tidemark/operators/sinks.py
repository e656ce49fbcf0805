"""Writes that keep keyed tables and run logs: partition-wise upserts of Parquet tables, counters taken while a run writes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import assembly, writes
from tidemark.operators.lineage import bounded_broadcast, checkpointed


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at path with these columns; empty where there is none yet."""
    try:
        spark.read.parquet(path).schema  # noqa: B018  asks whether there are files
    except AnalysisException as none:
        if none.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def upsert_partitions(batch: DataFrame, path: str, keys: list[str], partition: list[str], newest: list | None = None) -> None:
    """Puts batch into the Parquet table at path, partitioned by `partition`: the batch's row wins for its key.

    Only partitions that the batch touches are read and written anew; files of all others stay as they are, and so do all files if
    the batch is empty. The partition of a row must follow from its key, so that a key never moves. The new content of the touched partitions is
    written aside first: a lost executor or a failed run leaves the table as it was, and a batch may be run again. A null
    partition value is a partition, too; null keys are equal."""
    missing = [c for c in (*keys, *partition) if c not in batch.columns]
    if missing:
        raise ValueError(f"the batch lacks {missing}")
    spark = batch.sparkSession
    new = checkpointed(writes.dedup_by_key(batch, keys, newest) if newest is not None else batch)
    touched = bounded_broadcast(new.select(*partition).distinct())
    table = read_table(spark, path, batch.schema)
    same = [table[c].eqNullSafe(touched[c]) for c in partition]
    old = table.join(touched, _all(same), "left_semi")
    known = new.select(*keys).distinct()
    kept = old.join(known, _all([old[c].eqNullSafe(known[c]) for c in keys]), "left_anti")
    merged = checkpointed(kept.select(*batch.columns).unionByName(new))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


class Run:
    """A run that is being logged."""

    def __init__(self, kind: str):
        self.run_id, self.kind = uuid.uuid4().hex, kind
        self._seen: list[Observation] = []

    def counting(self, rows: DataFrame, /, **counters: Column) -> DataFrame:
        """rows, with these aggregates taken while they are written; the rows must be written inside the run, and once."""
        self._seen.append(Observation(f"{self.kind}-{len(self._seen)}-{self.run_id}"))
        return rows.observe(self._seen[-1], *[c.alias(k) for k, c in counters.items()])

    def counters(self) -> dict[str, int]:
        return {k: v for seen in self._seen for k, v in seen.get.items()}


_RUNS = "run_id string, run_type string, started_at timestamp, finished_at timestamp, status string, error_msg string, counters map<string,long>"


def _note(spark: SparkSession, folder: str, run: Run, status: str, error: str | None = None, counters: dict | None = None) -> None:
    started = status == "running"
    row = spark.createDataFrame([(run.run_id, run.kind, status, error, counters)], "run_id string, run_type string, status string, error_msg string, counters map<string,long>")
    now, never = F.current_timestamp(), F.lit(None).cast("timestamp")
    stamped = row.withColumns({"started_at": now if started else never, "finished_at": never if started else now})
    stamped.select(*T._parse_datatype_string(_RUNS).names).coalesce(1).write.mode("append").parquet(f"{folder}/{'started' if started else 'ended'}")


@contextmanager
def logged_run(spark: SparkSession, folder: str, kind: str) -> Iterator[Run]:
    """Logs a run in folder: a row when it begins, one when it ends with its counters, or with the error that ended it."""
    run = Run(kind)
    _note(spark, folder, run, "running")
    try:
        yield run
    except BaseException as error:
        _note(spark, folder, run, "failed", f"{type(error).__name__}: {error}"[:2000])
        raise
    _note(spark, folder, run, "success", None, run.counters())


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row a run; those that have not ended are `running`."""
    schema = T._parse_datatype_string(_RUNS)
    ended = read_table(spark, f"{folder}/ended", schema).select("run_id", "finished_at", "status", "error_msg", "counters")
    return assembly.run_audit(read_table(spark, f"{folder}/started", schema), ended)


def recent_runs(runs: DataFrame, n: int = 10, at: str = "started_at") -> DataFrame:
    """The n latest runs, those of one moment by id."""
    return runs.orderBy(F.desc_nulls_last(at), "run_id").limit(n)
