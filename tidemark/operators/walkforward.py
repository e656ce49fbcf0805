"""Walk-forward evaluation with a refit for every fold, in one pass over the rows.

Least squares needs of the rows only their sums (n, X'y, X'X). These are summed by date, and running sums over the dates give
the sums of every training span, expanding or rolling: a fold's fit is one small solve, and no fold reads
the rows again. Rows are then scored on their test dates with the coefficients of their fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import evaluation as ev, portfolio

METRICS = ("mae", "rmse", "hit_rate", "ic")


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def date_sums(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """date, n, xy (array), xx (array, upper triangle by rows) of the rows without nulls; the constant 1 is the first feature."""
    known = rows.select("date", *features, label).dropna()
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    y = F.col(label).cast("double")
    return known.groupBy("date").agg(F.count("*").alias("n"), F.array(*[F.sum(a * y) for a in x]).alias("xy"), F.array(*[F.sum(x[i] * x[j]) for i, j in _pairs(len(x))]).alias("xx"))


def solve(xx: np.ndarray, xy: np.ndarray, n: float, features: int, ridge: float) -> np.ndarray:
    """Intercept and coefficients from sums. The penalty ridge * n holds for features of mean 0 and deviation 1; a constant feature gets 0."""
    full = np.zeros((features + 1, features + 1))
    for (i, j), v in zip(_pairs(features + 1), xx, strict=True):
        full[i, j] = full[j, i] = v
    mean, mean_y = full[0, 1:] / n, xy[0] / n
    cov, cross = full[1:, 1:] / n - np.outer(mean, mean), xy[1:] / n - mean * mean_y
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    live = dev > 1e-12 * np.maximum(1.0, np.abs(mean))
    out = np.zeros(features)
    if live.any():
        d = dev[live]
        corr = cov[np.ix_(live, live)] / np.outer(d, d) + ridge * np.eye(len(d))
        out[live] = np.linalg.lstsq(corr, cross[live] / d, rcond=None)[0] / d
    return np.concatenate([[mean_y - mean @ out], out])


def fold_fits(rows: DataFrame, folds: DataFrame, features: list[str], label: str, ridge: float = 0.0, span: int | None = None) -> DataFrame:
    """fold, n_train, coefficients (intercept first) from the rows up to train_end of each fold; with span only from its last `span` dates.

    Folds of fewer training rows than coefficients are left out."""
    width = len(features) + 1
    w = Window.orderBy("date")  # one row a date
    so_far = w.rowsBetween(Window.unboundedPreceding, 0) if span is None else w.rowsBetween(-(span - 1), 0)
    # a date whose rows all hold nulls counts as a date of the span
    daily = rows.select("date").distinct().join(date_sums(rows, features, label), "date", "left")
    running = [F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("n_train")]
    running += [F.array(*[F.sum(F.col(c)[i]).over(so_far) for i in range(size)]).alias(c) for c, size in (("xy", width), ("xx", len(_pairs(width))))]
    sums = daily.select(F.col("date").alias("train_end"), *running)

    def fit(batches):
        for b in batches:
            found = [solve(np.array(xx), np.array(xy), n, width - 1, ridge).tolist() for xx, xy, n in zip(b["xx"], b["xy"], b["n_train"], strict=True)]
            yield pd.DataFrame({"fold": b["fold"], "n_train": b["n_train"], "coefficients": found})

    wanted = folds.select("fold", "train_end").join(sums, "train_end").where(F.col("n_train") >= width)
    return wanted.select("fold", "n_train", "xy", "xx").mapInPandas(fit, "fold int, n_train long, coefficients array<double>")


def linear_prediction(features: list[str], coefficients: str = "coefficients") -> Column:
    return sum((F.col(coefficients)[i + 1] * F.col(c) for i, c in enumerate(features)), F.col(coefficients)[0])


def walk_forward(rows: DataFrame, models: dict[str, list[str]], label: str, blend: dict[str, float] | None = None, ridge: float = 0.0, train: int = 180, test: int = 21, step: int = 21,
                 span: int | None = None, least: int = 10) -> DataFrame:
    """One row a fold: fold, train_end, test_start, test_end, n_train, n_test, and mae, rmse, hit_rate, ic of every model (`mae_<model>`).

    models: features by name; each is fitted anew for each fold. blend: weights of models, scored as `ens`. Folds with fewer than
    `least` rows that every model can score are left out. Features that look back were taken from all rows, so tests need no warm-up rows."""
    folds = ev.walk_forward_folds(rows.select("date").distinct(), train, test, step)
    w = Window.orderBy("date")
    numbered = rows.select("date").distinct().select("date", (F.row_number().over(w) - 1).alias("i"))
    starts = numbered.join(folds.select("fold", F.col("test_start").alias("date")), "date").select("fold", F.explode(F.sequence(F.col("i"), F.col("i") + test - 1)).alias("i"))
    days = starts.join(numbered, "i").select("fold", "date")  # one row a date and fold
    known = rows.dropna(subset=sorted({label, *[c for f in models.values() for c in f]}))
    scored, n_train = known.join(F.broadcast(days), "date"), None
    for name, features in models.items():
        fits = fold_fits(rows, folds, features, label, ridge, span)
        scored = scored.join(F.broadcast(fits.select("fold", F.col("coefficients").alias("_c"), F.col("n_train").alias(f"_n_{name}"))), "fold")
        scored = scored.withColumn(f"_p_{name}", linear_prediction(features, "_c")).drop("_c")
        n_train = F.min(f"_n_{name}") if n_train is None else F.least(n_train, F.min(f"_n_{name}"))
    shown = {name: F.col(f"_p_{name}") for name in models}
    if blend:
        shown["ens"] = sum((F.lit(weight) * shown[name] for name, weight in blend.items()), F.lit(0.0))
    figures = {f"{k}_{name}": c for name, p in shown.items() for k, c in portfolio.forecast_metrics(p, F.col(label)).items()}
    out = scored.groupBy("fold").agg(n_train.alias("n_train"), F.count("*").alias("n_test"), *[c.alias(k) for k, c in figures.items()]).where(F.col("n_test") >= least)
    return folds.select("fold", "train_end", "test_start", "test_end").join(out, "fold")


def fold_means(results: DataFrame) -> DataFrame:
    """metric, model, mean, folds: means over the folds of walk_forward; folds without a value don't count."""
    names = [c for c in results.columns if c.split("_")[0] in {m.split("_")[0] for m in METRICS}]
    long = results.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in names])).alias("e")).select("e.*")
    metric = F.coalesce(*[F.when(F.col("k").startswith(f"{m}_"), m) for m in METRICS])
    return long.groupBy(metric.alias("metric"), F.substr("k", F.length(metric) + 2).alias("model")).agg(
        F.avg("v").alias("mean"), F.count("v").alias("folds"))
