"""Statistics over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.lineage import checkpointed


def moments(x: Column) -> dict[str, Column]:
    """Sample deviation, bias-corrected skew and excess kurtosis; null where there are too few values."""
    n, g1, g2 = F.count(x), F.skewness(x), F.kurtosis(x)
    return {"std": F.stddev_samp(x), "skew": F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2), "excess_kurtosis": F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)}


def histogram_kl(samples: DataFrame, bins: int = 20, eps: float = 1e-9) -> DataFrame:
    """KL divergence of samples(side 0/1, x): equal bins over the joint range, the last one closed."""
    span = samples.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counts = samples.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("q"))
    grid = samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select(
        (F.coalesce("p", F.lit(0)) + eps).alias("p"), (F.coalesce("q", F.lit(0)) + eps).alias("q"))
    total = grid.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    p, q = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    return grid.crossJoin(F.broadcast(total)).agg(F.round(F.sum(p * F.log(p / q)), 6).alias("kl"))


#: Ranges that a column's values are dealt to while ranks are looked for.
RANGES = 64


def exact_quantiles(rows: DataFrame, columns: list[str], probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """by, column, probability, value: exact quantiles (linear between two values) of columns, without a task that holds a column's values.

    Equal values are counted before and by the shuffle. A sketch cuts each column's distinct values into RANGES ranges of about
    equal numbers; sums by range tell in which range a rank lies, and only those ranges are ordered, each by itself. So a task orders about
    1 / RANGES of the distinct values of a column, on disk if need be. Nulls don't count; a column without values has no rows."""
    by = list(by or [])
    keys = [*by, "column"]
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_e"))
    counts = checkpointed(long.select(*by, "_e.column", "_e.v").where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("n")))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 20 * RANGES).alias("cuts"), F.sum("n").alias("_all"))
    ranged = _same(counts, cuts, keys).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    w = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # at most RANGES rows
    totals = ranged.groupBy(*keys, "range", "_all").agg(F.sum("n").alias("_n")).withColumn("_to", F.sum("_n").over(w)).withColumn("_from", F.col("_to") - F.col("_n"))
    # the position p * (n - 1) lies between two ranks, counted from 0
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    places = totals.select(*keys, "range", "_from", "_to", "_all", wanted).withColumn("_at", F.col("probability") * (F.col("_all") - 1))
    ranks = places.select(*keys, "range", "_from", "_to", "probability", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("rank")).distinct()
    ranks = checkpointed(ranks.where((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))))
    needed = ranks.select(*keys, "range", "_from").distinct()
    near = _same(ranged.drop("_all"), needed, [*keys, "range"])
    inside = Window.partitionBy(*keys, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    spans = near.withColumn("_end", F.col("_from") + F.sum("n").over(inside)).withColumn("_begin", F.col("_end") - F.col("n")).drop("_from")
    hit = _same(spans, ranks.select(*keys, "range", "probability", "_at", "rank"), [*keys, "range"]).where((F.col("rank") >= F.col("_begin")) & (F.col("rank") < F.col("_end")))
    low, high = F.min(F.struct("rank", "v"))["v"], F.max(F.struct("rank", "v"))["v"]
    below = F.first("_at") - F.min("rank")
    value = F.when(F.max("rank") == F.min("rank"), low).otherwise((F.max("rank") - F.first("_at")) * low + below * high)
    return hit.groupBy(*keys, "probability").agg(value.alias("value"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join of equal keys, nulls being equal."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(other, condition).drop(*[f"_r_{k}" for k in keys])


def medians(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    return exact_quantiles(rows, [column], [0.5], by).select(*by, F.col("value").alias("med"))
