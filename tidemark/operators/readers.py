"""Reads of the stored tables: windows of days, filters, newest rows, histories, log files. `as_of` is always given, never today."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def last_n_days(rows: DataFrame, as_of: str, n: int, date: str = "date") -> DataFrame:
    """Rows of the n days before as_of and of as_of itself; the bound is a literal, so it reaches the scan."""
    day = F.lit(as_of).cast("date")
    return rows.where((F.col(date) >= F.date_sub(day, n)) & (F.col(date) <= day))


def filter_trades(trades: DataFrame, status: str | None = None, symbol: str | None = None, as_of: str | None = None, days: int | None = None, limit: int | None = None) -> DataFrame:
    """Trades by those of the filters that are given; limit keeps the newest (a top-k report)."""
    out = trades
    if status is not None:
        out = out.where(F.col("status") == status)
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol)
    if days is not None:
        out = last_n_days(out, as_of, days)
    return out if limit is None else newest(out, limit, "date", "symbol")


def newest(rows: DataFrame, n: int, date: str, *ties: str) -> DataFrame:
    """The n newest rows (top-k report): each task keeps n."""
    return rows.orderBy(F.desc(date), *ties).limit(n)


def display_columns(rows: DataFrame, ids: dict[str, int] | None = None, times: list[str] | None = None, percents: list[str] | None = None, digits: int = 2) -> DataFrame:
    """rows with ids cut to a prefix, times as text and shares as rounded percent."""
    changed = {c: F.substring(c, 1, n) for c, n in (ids or {}).items()}
    changed |= {c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in times or []}
    changed |= {c: F.round(F.col(c) * 100, digits) for c in percents or []}
    return rows.withColumns(changed) if changed else rows


def signals_by_conviction(signals: DataFrame, day: str) -> DataFrame:
    """The signals of a day with rank: strongest |z_score| first, ties by symbol."""
    some = signals.where((F.col("date") == F.lit(day).cast("date")) & (F.col("signal") != "FLAT"))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.abs("z_score")), "symbol")))


def latest_snapshot(snapshots: DataFrame, date: str = "date") -> DataFrame:
    """The newest row, by one aggregation (no sort)."""
    return snapshots.agg(F.max_by(F.struct(*snapshots.columns), date).alias("s")).where("s is not null").select("s.*")


def pnl_heatmap(trades: DataFrame, pivot: list[str] | None = None) -> DataFrame:
    """date (of exit), symbol, pnl of closed trades; with the symbols to show, one column for each."""
    closed = trades.where("status = 'closed'")
    if pivot is None:
        return closed.groupBy(F.col("exit_date").alias("date"), "symbol").agg(F.sum("pnl_net").alias("pnl"))
    return closed.groupBy(F.col("exit_date").alias("date")).pivot("symbol", pivot).agg(F.sum("pnl_net"))


def history(rows: DataFrame, symbol: str, columns: list[str], first: str | None = None, date: str = "date") -> DataFrame:
    """date and columns of one symbol from `first` on; the filters reach the scan. Readers sort what they show."""
    some = rows.where(F.col("symbol") == symbol)
    return (some if first is None else some.where(F.col(date) >= F.lit(first).cast("date"))).select(date, *columns)


def scaled_benchmark(strategy: DataFrame, benchmark: DataFrame, date: str = "date") -> DataFrame:
    """benchmark (date, value) scaled so that it starts at the strategy's first value."""
    first = strategy.agg(F.min_by("value", date).alias("_s")).crossJoin(benchmark.agg(F.min_by("value", date).alias("_b")))  # one row
    return benchmark.crossJoin(F.broadcast(first)).select(date, (F.col("value") * F.col("_s") / F.col("_b")).alias("value"))


def concat_warmup(train: DataFrame, val: DataFrame, days: int = 30, date: str = "date") -> DataFrame:
    """val with the rows of the last `days` dates of train before it."""
    last = train.select(date).distinct().orderBy(F.desc(date)).limit(days)
    return train.join(F.broadcast(last), date, "left_semi").select(*val.columns).unionByName(val)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, last: int | None = None, order: str = "at") -> DataFrame:
    """Objects of a log of one JSON object a line; lines that don't parse are passed over. `last` keeps the newest (a report)."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if last is None else newest(rows, last, order)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed rows of a folder of CSV files, each with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)
