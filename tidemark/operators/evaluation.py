"""Samples, splits, losses, blending, comparison tests and health checks of forecasts."""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tidemark.operators import stats


def sequence_windows(features: DataFrame, columns: list[str], label: str, length: int = 30, outlier: float = 0.10, labelled: bool = True) -> DataFrame:
    """symbol, date, window (the `length` rows before, as arrays), label; rows without a label or with an extreme one go (with labelled=False they stay)."""
    past = Window.partitionBy("symbol").orderBy("date").rowsBetween(-length, -1)
    out = features.select("symbol", "date", F.collect_list(F.array(*columns)).over(past).alias("window"), F.col(label).alias("label"))
    whole = F.size("window") == length
    return out.where(whole & (F.abs("label") <= outlier) if labelled else whole)


def chronological_split(rows: DataFrame, train: float = 0.70, val: float = 0.15, date: str = "date") -> DataFrame:
    """rows plus split: train, val or test by the position of the date among the distinct dates (one small row each)."""
    days = rows.select(date).distinct()
    k, n = F.row_number().over(Window.orderBy(date)), F.count("*").over(Window.partitionBy())
    split = F.when(k <= F.floor(n * train), "train").when(k <= F.floor(n * (train + val)), "val").otherwise("test")
    return rows.join(days.select(date, split.alias("split")), date)


def robust_scale(rows: DataFrame, columns: list[str], fit: DataFrame) -> DataFrame:
    """(x - median) / (q75 - q25) with the exact quartiles of fit; a range of zero counts as one. One row is broadcast."""
    long = stats.exact_quantiles(fit, columns, [0.25, 0.5, 0.75])
    at = lambda c, p: F.max(F.when((F.col("column") == c) & (F.col("probability") == p), F.col("value")))
    q = long.agg(*[F.array(*[at(c, p) for p in (0.25, 0.5, 0.75)]).alias(f"_q_{c}") for c in columns])

    def scaled(c):
        low, mid, high = (F.col(f"_q_{c}")[i] for i in range(3))
        return ((F.col(c) - mid) / F.when(high == low, 1.0).otherwise(high - low)).alias(c)

    return rows.crossJoin(F.broadcast(q)).select(*[scaled(c) if c in columns else F.col(c) for c in rows.columns])


def directional_huber(pred: Column, actual: Column, delta: float = 0.005) -> Column:
    """0.6 Huber + 0.4 mean relu(-p y / s^2), s the mean of |y|. The scale leaves the relu, so one aggregation is enough."""
    e = F.abs(pred - actual)
    huber = F.avg(F.when(e < delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))
    scale = F.avg(F.abs(actual)) + 1e-8
    return 0.6 * huber + 0.4 * F.avg(F.greatest(-pred * actual, F.lit(0.0))) / (scale * scale)


def blend(a: Column, b: Column, weight: float) -> Column:
    return weight * a + (1 - weight) * b


def tune_blend(rows: DataFrame, a: str, b: str, actual: str, by: list[str], steps: int = 10) -> DataFrame:
    """by, weight, rmse: the weight in 0, 1/steps .. 1 with the smallest error, the first of equal ones.

    The squared error is a quadratic in the weight: three averages of one pass serve all weights."""
    d, e = F.col(a) - F.col(b), F.col(b) - F.col(actual)
    m = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(actual).isNotNull()).groupBy(*by).agg(
        F.avg(d * d).alias("dd"), F.avg(d * e).alias("de"), F.avg(e * e).alias("ee"))
    tried = m.select(*by, "dd", "de", "ee", F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)])).alias("w"))
    mse = F.round(F.greatest(F.col("w") * F.col("w") * F.col("dd") + 2 * F.col("w") * F.col("de") + F.col("ee"), F.lit(0.0)), 14)
    best = tried.groupBy(*by).agg(F.min(F.struct(mse.alias("mse"), F.col("w"))).alias("m"))
    return best.select(*by, F.col("m.w").alias("weight"), F.sqrt("m.mse").alias("rmse"))


def walk_forward_folds(dates: DataFrame, train: int = 180, test: int = 21, step: int = 21, warm_up: int = 30) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end over a table of distinct dates; training starts at the first date.

    A fold's rows to read begin warm_up dates before its test (warm_start). Folds end with the last whole test span."""
    i = F.row_number().over(Window.orderBy("date")) - 1
    numbered = dates.select("date", i.alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    fold = (F.floor((F.col("i") - train) / step) + 1).cast("int")
    ends = numbered.where((F.col("i") >= train) & ((F.col("i") - train) % step == 0) & (F.col("i") + test <= F.col("n")))
    at = numbered.select(F.col("i").alias("j"), F.col("date").alias("d"))
    out = ends.select(fold.alias("fold"), F.col("date").alias("test_start"), "i")
    for name, shift in (("train_end", -1), ("test_end", test - 1), ("warm_start", -warm_up)):
        out = out.join(at.withColumnRenamed("d", name), F.col("j") == F.greatest(F.col("i") + shift, F.lit(0))).drop("j")
    return out.crossJoin(F.broadcast(dates.agg(F.min("date").alias("train_start")))).drop("i")


def performance_table(returns: DataFrame, least: int = 5) -> DataFrame:
    """One row a series of returns(series, date, ret: log return), in percent but for sharpe and n_days."""
    known = returns.where("ret is not null")
    so_far = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = known.withColumn("v", F.exp(F.sum("ret").over(so_far))).withColumn("dd", F.col("v") / F.max("v").over(so_far) - 1)
    year, vol = F.avg("ret") * 252, F.stddev_samp("ret") * F.sqrt(F.lit(252.0))
    out = curve.groupBy("series").agg((F.expm1(F.sum("ret")) * 100).alias("total_return"), (year * 100).alias("ann_return"), (vol * 100).alias("ann_vol"),
                                      F.when(vol > 0, year / vol).otherwise(0.0).alias("sharpe"), (F.min("dd") * 100).alias("max_dd"), F.count("*").alias("n_days"))
    return out.where(F.col("n_days") >= least)


def single_factor(returns: DataFrame, y: str, x: str, by: list[str], least: int = 20) -> DataFrame:
    """Least squares of y on x with an intercept: beta, its t value, yearly alpha, r2."""
    n = F.regr_count(y, x)
    r2, beta = F.regr_r2(y, x), F.regr_slope(y, x)
    t = F.signum(beta) * F.sqrt(r2 * (n - 2) / (1 - r2))
    return returns.groupBy(*by).agg(n.alias("n"), beta.alias("beta"), t.alias("t"), (F.regr_intercept(y, x) * 252).alias("alpha"), r2.alias("r2")).where(F.col("n") >= least)


def diebold_mariano(errors: DataFrame, a: str, b: str, by: str, order: str, h: int = 1) -> DataFrame:
    """by, n, dm, p_value (Student): the statistic of squared-error differences, lags below h, with the small-sample factor."""
    e = errors.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(by, order, (F.col(a) * F.col(a) - F.col(b) * F.col(b)).alias("d"))
    w = Window.partitionBy(by).orderBy(order)
    for lag in range(1, h):
        e = e.withColumn(f"d{lag}", F.lag("d", lag).over(w))
    n, var = F.count("d"), F.var_samp("d")
    for lag in range(1, h):
        var = var + 2 * (1 - lag / h) * F.coalesce(F.covar_samp("d", f"d{lag}"), F.lit(0.0))
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    out = e.groupBy(by).agg(n.alias("n"), (F.avg("d") / F.sqrt(F.greatest(var, F.lit(1e-12)) / n) * factor).alias("dm")).where("n >= 2")
    return out.withColumn("p_value", student_p("dm", (F.col("n") - 1).cast("double")))


def paired_t(rows: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    out = rows.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("mean_diff"), (F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0.0))).alias("t_stat"),
                   F.count(d).alias("n"))
    return out.withColumn("p_value", student_p("t_stat", (F.col("n") - 1).cast("double")))


def bootstrap_ci(values: DataFrame, col: str, order: list, statistic, draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """estimate, low, high, std_error of statistic(column) over `draws` resamples.

    Each row is in a draw as often as a Poisson number of mean one that a hash of seed, draw and row decides, so no row is numbered,
    no draw is gathered and a lost executor draws the same again; rows equal in col and order share their numbers. statistic is an aggregate of single rows."""
    known = values.where(F.col(col).isNotNull())
    u = F.pmod(F.xxhash64(F.lit(seed), "_b", *order, F.col(col)), F.lit(1 << 40)) / float(1 << 40)
    times, chance, total = F.lit(0), math.exp(-1), 0.0
    for k in range(1, 12):  # the number is at least k where u passes the chance of fewer
        total += chance
        times = times + (u >= total).cast("int")
        chance /= k
    drawn = known.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_n", times).where("_n > 0")
    each = drawn.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).groupBy("_b").agg(statistic(F.col(col)).alias("s"))
    tail = (1 - level) / 2
    spread = each.agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"), F.stddev_samp("s").alias("std_error"))
    return known.agg(statistic(F.col(col)).alias("estimate")).crossJoin(spread)


_SHARES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def draw_counts(hashes: np.ndarray, draw: int) -> np.ndarray:
    """How often each row (by its 64-bit hash) is in a draw: Poisson of mean one, from the mixed bits of hash and draw."""
    h = hashes.astype(np.uint64) + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_SHARES, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right")


def bootstrap_moments(values: DataFrame, col: str, order: list, statistic: Callable[[Column, Column, Column], Column], draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """estimate, low, high, std_error as bootstrap_ci, for a statistic of the number of values, their sum and their sum of squares.

    Each task keeps these three sums for every draw, so a row costs some arithmetic for a draw and no row is multiplied; a task hands on
    `draws` rows, whatever it has read."""
    known = values.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"), F.xxhash64(F.lit(seed), *order, F.col(col)).alias("h"))

    def summed(batches):
        sums = np.zeros((draws, 3))
        for b in batches:
            x, h = b.column("x").to_numpy(), b.column("h").to_numpy()
            powers = np.stack([np.ones(len(x)), x, x * x], axis=1)
            for d in range(draws):
                sums[d] += draw_counts(h, d) @ powers
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *(pa.array(c) for c in sums.T)], names=["draw", "n", "s1", "s2"])

    parts = known.mapInArrow(summed, "draw long, n double, s1 double, s2 double").groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    each = parts.where("n > 0").select(statistic(F.col("n"), F.col("s1"), F.col("s2")).alias("s"))
    tail = (1 - level) / 2
    spread = each.agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"), F.stddev_samp("s").alias("std_error"))
    whole = known.agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    return whole.select(statistic(F.col("n"), F.col("s1"), F.col("s2")).alias("estimate")).crossJoin(spread)


def sharpe_of_sums(n: Column, s1: Column, s2: Column) -> Column:
    """The yearly Sharpe ratio from sums; 0 for fewer than two values or none that differ."""
    var = F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0))
    return F.when((n >= 2) & (var > 1e-300), s1 / n / F.sqrt(var) * F.sqrt(F.lit(252.0))).otherwise(0.0)


def _check(metric: str, value: Column, n: Column, threshold: float, bad: Column, least: int = 5):
    enough = n >= least
    return [F.lit(metric).alias("metric"), F.when(enough, value).alias("value"), F.lit(threshold).alias("threshold"), n.alias("n"),
            F.when(~enough, "insufficient_data").when(bad, "alert").otherwise("ok").alias("status")]


def health_report(snapshots: DataFrame, trades: DataFrame, sentiment: DataFrame, sharpe: float = 0.5, hit: float = 0.48, ic: float = 0.02,
                  bias: float = 0.55, drift: float = 0.15) -> DataFrame:
    """metric, value, threshold, n, status of five checks, for tables of the window to check.

    snapshots: daily_return. trades: pnl_net, pred_ret, actual_ret. sentiment: date, sent_spread. Too few rows: insufficient_data."""
    r = F.col("daily_return")
    ratio = F.when(F.stddev_samp(r) > 0, F.avg(r) / F.stddev_samp(r) * F.sqrt(F.lit(252.0))).otherwise(0.0)
    out = snapshots.agg(*_check("rolling_sharpe", ratio, F.count(r), sharpe, ratio < sharpe))
    wins = F.avg((F.coalesce("pnl_net", F.lit(0.0)) > 0).cast("double"))
    out = out.unionByName(trades.agg(*_check("hit_rate", wins, F.count(F.lit(1)), hit, wins < hit)))
    both = trades.where("pred_ret is not null and actual_ret is not null")
    rank, wrong = F.corr("pred_ret", "actual_ret"), F.avg((F.signum("pred_ret") != F.signum("actual_ret")).cast("double"))
    out = out.unionByName(both.agg(*_check("information_coefficient", rank, F.count(F.lit(1)), ic, ~F.coalesce(rank >= ic, F.lit(False)))))
    out = out.unionByName(both.agg(*_check("prediction_bias", wrong, F.count(F.lit(1)), bias, wrong > bias)))
    return out.unionByName(drift_check(sentiment, drift))


def drift_check(sentiment: DataFrame, threshold: float = 0.15, least: int = 20) -> DataFrame:
    """Divergence of the second half of the values, by date, from the first."""
    known = sentiment.where("sent_spread is not null").select("date", F.col("sent_spread").alias("x"))
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    days = known.groupBy("date").agg(F.count("*").alias("n")).withColumns({"upto": F.sum("n").over(so_far), "rows": F.sum("n").over(Window.partitionBy())})
    days = days.select("date", (F.floor(F.col("rows") / 2) - (F.col("upto") - F.col("n"))).alias("take"), "n")  # how many of the date lie in the first half
    placed = known.join(F.broadcast(days), "date")
    # Only the one date that the half falls into is ranked.
    rank = F.row_number().over(Window.partitionBy("date").orderBy("x"))
    split = placed.where("take > 0 and take < n").select((rank > F.col("take")).cast("int").alias("side"), "x")
    whole = placed.where("take <= 0 or take >= n").select((F.col("take") <= 0).cast("int").alias("side"), "x")
    kl = stats.histogram_kl(whole.unionByName(split)).crossJoin(known.agg(F.count("*").alias("rows")))
    return kl.select(*_check("sentiment_drift", F.col("kl"), F.col("rows"), threshold, F.col("kl") > threshold, least))


def leg_returns(legs: DataFrame, ret: str) -> DataFrame:
    """date, ret: mean of the long leg less mean of the short one; a leg without rows counts as zero."""
    side = lambda leg: F.coalesce(F.avg(F.when(F.col("leg") == leg, F.col(ret))), F.lit(0.0))
    return legs.groupBy("date").agg((side("long") - side("short")).alias("ret"))


def benchmark_series(series: dict[str, DataFrame]) -> DataFrame:
    """strategy, date, daily_ret, cum_ret (the running sum) of several (date, ret: log return) tables in one long table."""
    rows = None
    for name, s in series.items():
        one = s.select(F.lit(name).alias("strategy"), "date", F.col("ret").alias("daily_ret"))
        rows = one if rows is None else rows.unionByName(one)
    so_far = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cum_ret", F.sum("daily_ret").over(so_far))


def deflated_sharpe(returns: DataFrame, ret: str, by: list[str], trials: int) -> DataFrame:
    """by, n, sharpe (yearly), skew, excess_kurtosis, dsr: the chance that the ratio beats the best of `trials` random strategies.

    One trial expects nothing above zero. Under four returns, or none that differ: dsr is null. The normal tail is taken over the few aggregated rows."""
    normal, gamma = statistics.NormalDist(), 0.5772156649
    best = 0.0 if trials < 2 else (1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e))
    m = stats.moments(F.col(ret))
    t = returns.groupBy(*by).agg(F.count(ret).alias("n"), (F.avg(ret) / F.nullif(m["std"], F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("sharpe"), m["skew"].alias("skew"),
                                 m["excess_kurtosis"].alias("excess_kurtosis"))
    spread = F.sqrt(1 - F.col("skew") * F.col("sharpe") + (F.col("excess_kurtosis") + 2) / 4 * F.col("sharpe") ** 2)
    z = (F.col("sharpe") - best * spread / F.sqrt(F.col("n") - 1)) * F.sqrt(F.col("n") - 1) / spread
    return t.withColumn("dsr", F.when(F.col("n") >= 4, normal_cdf(z)))


def _student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's distribution: the incomplete beta function I_x(df/2, 1/2), x = df / (df + t^2), by its continued fraction."""
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):  # modified Lentz steps
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14 and i:
            break
    return front * (f - 1)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of t with df degrees of freedom; for the few rows of an aggregated result."""
    return pd.Series([None if pd.isna(x) or pd.isna(n) or n <= 0 else _student_tail(abs(x), n) for x, n in zip(t, df)])


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(-x / math.sqrt(2)))


def factor_regression(rows: DataFrame, y: str, factors: list[str], by: list[str], least: int = 20) -> DataFrame:
    """by, factor (`alpha` for the yearly intercept), beta, t, p, r2, n of least squares on several factors; rows with a null go.

    Sums of products are added up by Spark; only the small normal equations of each group are solved in Python. p is Student's
    tail. A group with fewer rows, or with factors that depend on each other, has no result."""
    terms = ["_one", *factors]
    known = rows.dropna(subset=[y, *factors]).withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)) for a in [*terms, y] for b in [*terms, y]]
    products = known.groupBy(*by).agg(F.count("*").alias("n"), F.array(*sums).alias("s")).where(F.col("n") >= least)
    k = len(terms)

    @F.pandas_udf("array<struct<factor string, beta double, t double, p double, r2 double>>")
    def solved(n: pd.Series, s: pd.Series) -> pd.Series:
        def one(n, s):
            m = np.array(s, dtype=float).reshape(k + 1, k + 1)
            x, xy, yy = m[:k, :k], m[:k, k], m[k, k]
            if n <= k or np.linalg.matrix_rank(x) < k:
                return []
            inverse = np.linalg.inv(x)
            beta = inverse @ xy
            rest, total = max(yy - beta @ xy, 0.0), yy - m[0, k] ** 2 / n
            error = np.sqrt(np.diag(inverse) * rest / (n - k))
            t = np.divide(beta, error, out=np.full(k, np.inf), where=error > 0)
            r2 = 1 - rest / total if total > 0 else 0.0
            return [{"factor": "alpha" if i == 0 else factors[i - 1], "beta": float(beta[i] * (252 if i == 0 else 1)), "t": float(t[i]),
                     "p": _student_tail(abs(float(t[i])), float(n - k)), "r2": float(r2)} for i in range(k)]

        return pd.Series([one(a, b) for a, b in zip(n, s)])

    return products.select(*by, "n", F.explode(solved("n", "s")).alias("f")).select(*by, "n", "f.*")


def strategy_daily_return(trades: DataFrame, capital: float) -> DataFrame:
    """date, daily_ret: the net profit of a signal date's trades (pnl_net) as a share of capital."""
    return trades.groupBy("date").agg((F.sum("pnl_net") / capital).alias("daily_ret"))


def comparison_report(returns: DataFrame, factors: DataFrame) -> DataFrame:
    """series, metric, value: the performance table in long form, with the beta of every factor of the same series."""
    t = performance_table(returns)
    wide = [c for c in t.columns if c != "series"]
    long = t.select("series", *[F.col(c).cast("double").alias(c) for c in wide]).unpivot(["series"], wide, "metric", "value")
    return long.unionByName(factors.select("series", F.concat(F.lit("beta_"), "factor").alias("metric"), F.col("beta").alias("value")))


def health_history(report: DataFrame, day: str) -> DataFrame:
    """The checks of a day as one wide row: date, one value and one status a metric, alerts (how many)."""
    names = ["rolling_sharpe", "hit_rate", "information_coefficient", "prediction_bias", "sentiment_drift"]
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    cells = [pick(m, c).alias(m if c == "value" else f"{m}_status") for m in names for c in ("value", "status")]
    return report.agg(F.lit(day).cast("date").alias("date"), *cells, F.count_if(F.col("status") == "alert").alias("alerts"))
