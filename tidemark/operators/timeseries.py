"""Per-symbol indicators and portfolio curves as window expressions.

Every indicator uses the one window (symbol, ordered by date), so a plan with all of them has one shuffle and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import clip

def series():
    return Window.partitionBy("symbol").orderBy("date")


def last(n: int):
    return series().rowsBetween(-(n - 1), 0)


def full(value: Column, n: int, of: str = "close") -> Column:
    """value only where n rows are there."""
    return F.when(F.count(of).over(last(n)) == n, value)


def log_return(close: str = "close") -> Column:
    return F.round(F.coalesce(F.log(F.col(close) / F.lag(close).over(series())), F.lit(0.0)), 8)


def sma(n: int, col: str = "close") -> Column:
    return full(F.avg(col).over(last(n)), n, col)


def price_to_ma(n: int = 20) -> Column:
    return F.round(F.col("close") / sma(n) - 1, 6)


def realised_vol(n: int = 20, ret: str = "log_return_1d") -> Column:
    return full(F.stddev_samp(ret).over(last(n)), n, ret) * F.sqrt(F.lit(252.0))


def relative_volume(n: int = 20) -> Column:
    before = series().rowsBetween(-n, -1)
    return F.when((F.count("volume").over(before) == n) & (F.avg("volume").over(before) > 0), F.col("volume") / F.avg("volume").over(before))


def bollinger_position(n: int = 20) -> Column:
    m, s = F.avg("close").over(last(n)), F.stddev_samp("close").over(last(n))
    return full(F.when(s >= 1e-10, F.round(clip((F.col("close") - (m - 2 * s)) / (4 * s), -0.5, 1.5), 6)), n)


def rsi_wilder(n: int = 14, days: int = 120) -> Column:
    """Wilder's index over the last `days` calendar days, its averages seeded by the window's first change.

    One column expression that folds each row's window anew; with_rsi gives the same by window sums, for whole tables."""
    window = Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    closes = F.collect_list("close").over(window)
    changes = F.zip_with(F.slice(closes, F.lit(2), F.size(closes)), F.slice(closes, F.lit(1), F.size(closes) - 1), lambda b, a: b - a)
    start = F.struct(F.lit(None).cast("double").alias("g"), F.lit(None).cast("double").alias("l"))
    a = 1.0 / n

    def step(acc, d):
        up, down = F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0))
        return F.struct(F.coalesce(acc["g"] * (1 - a) + up * a, up).alias("g"), F.coalesce(acc["l"] * (1 - a) + down * a, down).alias("l"))

    def index(acc):
        return F.when((acc["g"] < 1e-10) & (acc["l"] < 1e-10), 50.0).when(acc["l"] < 1e-10, 100.0).otherwise(100 - 100 / (1 + acc["g"] / acc["l"]))

    return F.when(F.size(closes) > n, F.round(F.aggregate(changes, start, step, index), 4))


def with_rsi(bars: DataFrame, n: int = 14, days: int = 120, into: str = "rsi_14") -> DataFrame:
    """bars plus Wilder's index over the last `days` calendar days, its averages seeded by the window's first change.

    bars hold one row for each symbol and date, so a window has at most days + 1 rows. The average is a sum of changes
    weighted by (1 - 1/n) ** age. Closes are numbered and cut into blocks of days + 1; weights count from the start of a block and
    are summed up along it, so the sum over a window is the difference of two running sums: those at its last and its first row, or, as it touches two
    blocks at most, with the rest of the block before. Each row thus costs the same whatever the window holds. The index
    is null up to n closes; null closes count as absent rows and take the index of the closes before them."""
    rows = days + 1
    if n < 2 or rows * math.log(n / (n - 1)) > 600:
        raise ValueError("n must be 2 or more, and the weights of days + 1 rows must fit a double")
    a, running = 1.0 / n, Window.unboundedPreceding
    prior = F.last("close", ignorenulls=True).over(series().rowsBetween(running, -1))
    steps = bars.withColumn("_k", F.count("close").over(series().rowsBetween(running, 0))).withColumn("_d", F.col("close") - prior)
    steps = steps.withColumns({"_block": F.floor(F.col("_k") / rows), "_place": (F.col("_k") % rows).cast("double"), "_known": F.col("close").isNotNull()})
    grow = F.pow(F.lit(1 - a), -F.col("_place"))
    changed = F.col("_known") & F.col("_d").isNotNull()
    for side, change in (("g", F.col("_d")), ("l", -F.col("_d"))):
        steps = steps.withColumn(f"_{side}", F.when(changed, F.greatest(change, F.lit(0.0)) * grow).otherwise(0.0))
    block = Window.partitionBy("symbol", "_block")
    along = block.orderBy("date").rowsBetween(running, 0)
    sums = {f"_{kind}{side}": F.sum(f"_{side}").over(w) for side in "gl" for kind, w in (("to_", along), ("all_", block))}
    steps = steps.withColumns(sums)
    steps = steps.withColumn("_e", F.when(F.col("_known"), F.struct(*[F.col(f"_{c}").alias(c) for c in ("k", "block", "place", "g", "l", "to_g", "to_l", "all_g", "all_l")])))
    steps = steps.withColumn("_next", F.when(F.col("_known"), F.expr("lead(_e, 1) IGNORE NULLS OVER (PARTITION BY symbol ORDER BY date)")))
    window = Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    steps = steps.withColumn("_both", F.when(F.col("_known"), F.struct(F.col("_e").alias("e"), F.col("_next").alias("next"))))
    found = steps.withColumns({"_first": F.first("_both", ignorenulls=True).over(window),
                               "_now": F.last("_e", ignorenulls=True).over(series().rowsBetween(running, 0))})
    first, second, now = F.col("_first.e"), F.col("_first.next"), F.col("_now")

    def average(side):
        """The window's changes but for its first row's, which lies before it; the second row's is the seed and counts whole."""
        one = first["block"] == now["block"]
        own = now[f"to_{side}"] - F.when(one, first[f"to_{side}"]).otherwise(0.0)
        rest = F.when(one, 0.0).otherwise(first[f"all_{side}"] - first[f"to_{side}"])
        seed = (1 - a) * second[side]
        here = second["block"] == now["block"]
        return F.pow(F.lit(1 - a), now["place"]) * (a * own + F.when(here, seed).otherwise(0.0) + (1 - a) ** rows * (a * rest + F.when(here, 0.0).otherwise(seed)))

    g, l = F.col("_gain"), F.col("_loss")
    index = F.when((g < 1e-10) & (l < 1e-10), 50.0).when(l < 1e-10, 100.0).otherwise(100 - 100 / (1 + g / l))
    found = found.withColumns({"_gain": average("g"), "_loss": average("l")})
    return found.select(*bars.columns, F.when(now["k"] - first["k"] + 1 > n, F.round(index, 4)).alias(into))


def lag_return(n: int, ret: str = "log_return_1d") -> Column:
    return F.lag(ret, n).over(series())


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("log_return_1d", log_return())


def technical_features(bars: DataFrame, min_history: int = 60, days: int = 120) -> DataFrame:
    """All indicators on bar dates with at least min_history bars in the last `days` days."""
    recent = F.count("*").over(Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-days, 0))
    return with_returns(with_rsi(bars, days=days)).select(
        "symbol", "date", "rsi_14", sma(20).alias("ma_20"), sma(50).alias("ma_50"), price_to_ma().alias("price_to_ma20"),
        realised_vol().alias("vol_20d"), relative_volume().alias("rel_volume"), bollinger_position().alias("bb_position"),
        lag_return(1).alias("lag_ret_1d"), lag_return(2).alias("lag_ret_2d"), recent.alias("_recent")).where(F.col("_recent") >= min_history).drop("_recent")


def rolling_sharpe(ret: str = "ret", n: int = 30, by=None) -> Column:
    w = (by or series()).rowsBetween(-(n - 1), 0)
    s = F.stddev_samp(ret).over(w)
    return F.when((F.count(ret).over(w) == n) & (s > 0), F.avg(ret).over(w) * 252 / (s * F.sqrt(F.lit(252.0)))).otherwise(F.lit(0.0))


def drawdown(value: str = "close", by=None) -> Column:
    top = F.max(value).over((by or series()).rowsBetween(Window.unboundedPreceding, 0))
    return (F.col(value) - top) / top


def running_sum(col: str, by=None) -> Column:
    return F.sum(col).over((by or series()).rowsBetween(Window.unboundedPreceding, 0))


def month_start(date: str = "date") -> Column:
    return (F.row_number().over(Window.partitionBy("symbol", F.trunc(date, "month")).orderBy(date)) == 1).cast("int")


def momentum(n: int = 63, ret: str = "log_return_1d") -> Column:
    w = series().rowsBetween(-n, -1)
    return F.when(F.count(ret).over(w) == n, F.sum(ret).over(w))


def momentum_skip(skip: int = 21, back: int = 126) -> Column:
    return F.log(F.lag("close", skip).over(series()) / F.lag("close", back).over(series()))


def high_ratio(n: int = 252, today: bool = False, least: int = 60) -> Column:
    w = series().rowsBetween(-(n - 1), 0) if today else series().rowsBetween(-n, -1)
    return F.when(F.count("close").over(w) >= (least if today else n), F.col("close") / F.max("close").over(w))


def fill_gaps(col: str, causal: bool = False) -> Column:
    """Forward, then (unless causal) backward fill within the symbol."""
    ahead = F.last(col, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(col, ignorenulls=True).over(series().rowsBetween(0, Window.unboundedFollowing))
    return ahead if causal else F.coalesce(ahead, back)


def date_index(df: DataFrame) -> DataFrame:
    """(date, idx): dense 0-based index over the distinct dates; one row a date, so a single window task stays small."""
    return df.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"))
