"""Text scorers beside the default word lists: models as plug-ins, and weighted lexicons of any size joined as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import bounded_broadcast, checkpointed

SCORES = ("pos", "neg", "neu")
#: Words are runs of letters.
SPLIT = r"[^\p{L}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def score_with(load: Callable[[], Callable[[list], np.ndarray]], batch: int = 32) -> Callable[[Column], Column]:
    """A scorer for sentiment_daily and the like from a model: load() gives a function from texts (or their words, where the column
    holds those) to their rows (pos, neg, neu).

    load is called once a task, on the executor, and the function gets at most `batch` texts at a time. Null texts are empty.
    A model that load takes from a broadcast variable is held once by each worker."""

    @F.pandas_udf("pos double, neg double, neu double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for texts in parts:
            every = ["" if t is None else t for t in texts.tolist()]
            found = [np.asarray(scorer(every[i : i + batch]), dtype=float).reshape(-1, 3) for i in range(0, len(every), batch)]
            yield pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 3)), columns=list(SCORES))

    return run


# --- weighted lexicon ---------------------------------------------------------------------------------------------


def learn_lexicon(items: DataFrame, text: str, label: str, least: int = 5) -> DataFrame:
    """word, pos, neg: how much likelier a word is in items of label pos (neg) than in the others, as a log ratio, 0 where it is not.

    Over the words that stand in `least` items or more. Items of a null label don't count."""
    known = items.where(F.col(label).isNotNull()).select(F.col(label).alias("_l"), F.explode(F.array_distinct(words_of(F.col(text)))).alias("word"))
    n = items.where(F.col(label).isNotNull()).agg(*[F.count_if(F.col(label) == c).alias(f"_n_{c}") for c in ("pos", "neg")], F.count("*").alias("_n"))
    df = known.groupBy("word").agg(*[F.count_if(F.col("_l") == c).alias(f"_{c}") for c in ("pos", "neg")], F.count("*").alias("_df")).where(F.col("_df") >= least)
    ratio = lambda c: F.log((F.col(f"_{c}") + 0.5) / (F.col(f"_n_{c}") + 1)) - F.log((F.col("_df") - F.col(f"_{c}") + 0.5) / (F.col("_n") - F.col(f"_n_{c}") + 1))
    return df.crossJoin(F.broadcast(n)).select("word", *[F.greatest(ratio(c), F.lit(0.0)).alias(c) for c in ("pos", "neg")])  # one row of counts


def softmax(*parts: Column) -> list[Column]:
    top = F.greatest(*parts)
    powers = [F.exp(p - top) for p in parts]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def lexicon_scores(items: DataFrame, lexicon: DataFrame, key: str, text: str, sharpness: float = 10.0) -> DataFrame:
    """key, pos, neg, neu of each item: softmax of its mean positive weight, its mean negative one (both times sharpness) and 1.

    lexicon: word, pos, neg, of any size; it is broadcast up to a counted bound and shuffled beyond it. A word counts as often as it
    stands in the text; texts without words have weights of 0. key must tell the items apart."""
    found = items.select(F.col(key), F.explode(words_of(F.col(text))).alias("word"))
    each = lexicon.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    hits = found.join(bounded_broadcast(each), "word").groupBy(key).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_m"))
    size = F.greatest(F.size(words_of(F.col(text))), F.lit(1))
    rows = items.select(F.col(key), size.alias("_n")).join(hits, key, "left")
    mean = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.col("_n") * sharpness
    return rows.select(key, *[c.alias(k) for c, k in zip(softmax(mean("_p"), mean("_m"), F.lit(1.0)), SCORES, strict=True)])


# --- hashed linear model ------------------------------------------------------------------------------------------


class TextModel:
    """A linear model on hashed word counts: weights (3 classes, buckets) and biases, classes in the order of SCORES."""

    def __init__(self, weights: np.ndarray, biases: np.ndarray):
        self.weights, self.biases = weights, biases
        self._bucket = lru_cache(100_000)(self._hashed)

    def __reduce__(self):
        return TextModel, (self.weights, self.biases)

    def _hashed(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode(), 42)  # as Spark's xxhash64
        return (value - (1 << 64) if value >= 1 << 63 else value) % self.weights.shape[1]

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """Rows (pos, neg, neu) of texts that were split into words."""
        out = np.tile(self.biases, (len(texts), 1))
        for row, words in zip(out, texts, strict=True):
            if len(words):
                at = [self._bucket(w) if len(w) <= 64 else self._hashed(w) for w in words]  # long words aren't kept
                row += self.weights[:, at].sum(axis=1) / len(words)
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)

    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [(SCORES[c], float(self.biases[c]), self.weights[c].tolist()) for c in range(3)]
        spark.createDataFrame(rows, "label string, bias double, weights array<double>").coalesce(1).write.mode("overwrite").parquet(folder)

    @staticmethod
    def read(spark: SparkSession, folder: str) -> TextModel:
        rows = {r["label"]: r for r in spark.read.parquet(folder).collect()}  # three rows
        return TextModel(np.array([rows[c]["weights"] for c in SCORES]), np.array([rows[c]["bias"] for c in SCORES]))


def fit_text_model(items: DataFrame, text: str, label: str, buckets: int = 1 << 14, penalty: float = 1e-4, rounds: int = 60) -> TextModel:
    """Fits the model by logistic regression on Spark, on all items with a label pos, neg or neu.

    A feature is the share of a text's words that fall into a bucket. A class without items gets almost no share. The driver holds 3 * buckets weights.
    Shares are written once, as the fit reads them more than once."""
    number = F.array_position(F.array(*[F.lit(c) for c in SCORES]), F.col(label)) - 1
    hashed = F.transform(words_of(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("string"))
    rows = items.where(F.col(label).isin(*SCORES)).select(hashed.alias("_w"), number.cast("double").alias("_y"))
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], inputCol="_w", outputCol="_c").transform(rows)
    shares = Normalizer(p=1.0, inputCol="_c", outputCol="_x").transform(counted)
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=penalty, maxIter=rounds, standardization=False).fit(checkpointed(shares.select("_x", "_y")))
    known = fit.numClasses
    weights, biases = np.zeros((3, buckets)), np.full(3, -30.0)
    weights[:known], biases[:known] = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    return TextModel(weights, biases)


def model_scorer(model: Broadcast, batch: int = 32) -> Callable[[Column], Column]:
    """A scorer from a broadcast TextModel. Spark splits the texts into words, so words are the same as in the fit."""
    scored = score_with(lambda: model.value, batch)
    return lambda text: scored(words_of(text))
