"""Writers as set operations: what a keyed table holds after a batch.

A batch may hold a key several times. With `newest` (an order) only its first row a key counts; without it all of
them do, as given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedup_by_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _once(batch: DataFrame, keys: list[str], newest: list | None) -> DataFrame:
    return batch if newest is None else dedup_by_key(batch, keys, newest)


def insert_new(table: DataFrame, batch: DataFrame, keys: list[str], newest: list | None = None) -> DataFrame:
    """The rows of batch whose key the table lacks."""
    return _once(batch, keys, newest).join(table.select(*keys).distinct(), keys, "left_anti").select(*batch.columns)


def insert_or_ignore(table: DataFrame, batch: DataFrame, keys: list[str], newest: list | None = None) -> DataFrame:
    return table.unionByName(insert_new(table, batch, keys, newest))


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], newest: list | None = None) -> DataFrame:
    """Table after the batch: the batch's row wins for its key. By column name."""
    batch = _once(batch, keys, newest)
    return table.join(batch.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(batch.select(*table.columns))


def update_from(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], newest: list | None = None) -> DataFrame:
    """Table with columns taken from the changes of its keys where they are not null; changes without `newest` must have a key once."""
    new = _once(changes, keys, newest).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])
