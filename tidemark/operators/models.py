"""Return models: fitting, scoring, feature ablation, retraining. Fits run on Spark; only model parameters reach the driver."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev, portfolio
from tidemark.operators.lineage import checkpointed


def window_vector(window: Column, columns: int, pool: str = "flat") -> Column:
    """An array of rows (arrays of `columns` numbers, oldest first) as one vector.

    flat: all numbers, row after row, so a linear model has a weight for each lag; pooled: of each column its mean, its deviation, its
    last value and its change over the window."""
    if pool == "flat":
        return array_to_vector(F.flatten(window))
    n = F.size(window).cast("double")

    def of(i):
        mean = F.aggregate(window, F.lit(0.0), lambda s, x: s + x[i]) / n
        last = F.element_at(window, -1)[i]
        deviation = F.sqrt(F.aggregate(window, F.lit(0.0), lambda s, x: s + (x[i] - mean) * (x[i] - mean)) / n)
        return [mean, deviation, last, last - window[0][i]]

    return array_to_vector(F.array(*[c for i in range(columns) for c in of(i)]))


def windowed(rows: DataFrame, columns: list[str], label: str, length: int = 30, pool: str = "flat", labelled: bool = True) -> DataFrame:
    """symbol, date, x (vector of the `length` rows before), and label under its own name; windows with a null number go.

    With labelled=False rows without a label stay, for prediction."""
    made = ev.sequence_windows(rows, columns, label, length, labelled=labelled)
    whole = made.where(F.forall("window", lambda row: F.forall(row, lambda v: v.isNotNull() & ~F.isnan(v))))
    return whole.select("symbol", "date", window_vector(F.col("window"), len(columns), pool).alias("x"), F.col("label").alias(label))


def train_regressor(rows: DataFrame, features: list[str] | str, label: str, kind: str = "linear", seed: int = 42) -> PipelineModel:
    """linear: Huber loss; trees: boosted trees. features: columns, or the name of a vector column as windowed makes it.

    Rows with a null feature or label are left out of the fit."""
    vector = features if isinstance(features, str) else "_x"
    if kind == "linear":
        last = LinearRegression(featuresCol=vector, labelCol=label, loss="huber", maxIter=50)
    else:
        last = GBTRegressor(featuresCol=vector, labelCol=label, maxIter=10, maxDepth=4, seed=seed)
    named = [features] if isinstance(features, str) else features
    before = [] if isinstance(features, str) else [VectorAssembler(inputCols=features, outputCol="_x")]
    return Pipeline(stages=[*before, last]).fit(rows.select(*named, label).dropna())


def predict(model: PipelineModel, rows: DataFrame, features: list[str] | str) -> DataFrame:
    """rows plus pred_ret; rows with a null feature have no prediction and go."""
    return model.transform(rows.dropna(subset=[features] if isinstance(features, str) else features)).withColumnRenamed("prediction", "pred_ret").drop("_x")


def ablation(rows: DataFrame, groups: dict[str, list[str] | str], label: str, kind: str = "linear") -> DataFrame:
    """One row a feature group: errors on the test part of a chronological split, fitted on its training part.

    The split rows are written once; every fit and score reads them."""
    marked = checkpointed(ev.chronological_split(rows))
    out = None
    for name, features in groups.items():
        scored = predict(train_regressor(marked.where("split = 'train'"), features, label, kind), marked.where("split = 'test'"), features)
        m = portfolio.forecast_metrics(F.col("pred_ret"), F.col(label))
        one = scored.agg(F.lit(name).alias("features"), F.count(label).alias("n"), *[c.alias(k) for k, c in m.items()])
        out = one if out is None else out.unionByName(one)
    return out


def retrain_recent(rows: DataFrame, features: list[str] | str, label: str, folder: str, version: str, days: int = 365, least: tuple[int, int] = (50, 10)) -> DataFrame:
    """Fits on the last `days` days, writes the model to folder/version and returns its log row; older versions stay as archive.

    The last 15 % of the days are held out and alone are scored. Too few rows: status refused and no model."""
    known = rows.dropna(subset=[*([features] if isinstance(features, str) else features), label])
    end = known.agg(F.max("date").alias("_end"))
    recent = known.crossJoin(F.broadcast(end)).where(F.col("date") > F.date_sub("_end", days)).drop("_end")
    marked = checkpointed(ev.chronological_split(recent, 0.85, 0.15))
    counts = marked.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") != "train").alias("n_val"))
    n = counts.first()
    log = counts.select(F.lit(version).alias("version"), "n_train", "n_val")
    if n["n_train"] < least[0] or n["n_val"] < least[1]:
        return log.select("*", F.lit("refused").alias("status"), F.lit(None).cast("double").alias("rmse"), F.lit(None).cast("double").alias("hit_rate"))
    model = train_regressor(marked.where("split = 'train'"), features, label)
    model.write().overwrite().save(f"{folder}/{version}")
    m = portfolio.forecast_metrics(F.col("pred_ret"), F.col(label))
    scored = predict(model, marked.where("split != 'train'"), features).agg(m["rmse"].alias("rmse"), m["hit_rate"].alias("hit_rate"))
    return log.crossJoin(F.broadcast(scored)).select("version", "n_train", "n_val", F.lit("fitted").alias("status"), "rmse", "hit_rate")
