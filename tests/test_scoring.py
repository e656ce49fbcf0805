"""Scorers and models on windows."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev, models, news, scoring
from tidemark.operators.lineage import bounded_broadcast


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


GOOD, BAD, PLAIN = ("rise", "gain", "über"), ("fall", "loss", "año"), ("the", "bank", "on", "day", "of", "rate")


def texts(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tone = rng.choice(["pos", "neg", "neu"])
        own = {"pos": GOOD, "neg": BAD, "neu": ()}[tone]
        words = rng.choices(PLAIN, k=rng.randrange(4, 12)) + [rng.choice(own) for _ in range(2) if own]
        rng.shuffle(words)
        rows.append((i, " ".join(words).title(), tone))
    return rows + [(n, None, "neu"), (n + 1, "", None), (n + 2, "123 --", "neu"), (n + 3, "Rise " * 20_000, None)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(texts(), "id long, text string, tone string").cache()


def test_a_plug_in_gets_batches_and_is_loaded_once_a_task(spark):
    loads, largest = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def score(batch):
            if len(batch) > 7:
                largest.add(1)
            return [[len(t), 0.0, 1.0] for t in batch]

        return score

    df = spark.createDataFrame([(i, "x" * (i % 9) if i % 5 else None) for i in range(100)], "id long, t string").repartition(3)
    got = {r["id"]: r["s"]["pos"] for r in df.select("id", scoring.score_with(load, 7)(F.col("t")).alias("s")).collect()}
    assert got == {i: float(i % 9) if i % 5 else 0.0 for i in range(100)}
    assert loads.value <= 3 and largest.value == 0


def test_the_plug_in_model_hashes_as_spark_does_and_tells_the_tones(spark, items):
    model = scoring.fit_text_model(items, "text", "tone", buckets=512)
    scorer = scoring.model_scorer(spark.sparkContext.broadcast(model), 32)
    got = {r["id"]: (r["s"]["pos"], r["s"]["neg"], r["s"]["neu"]) for r in items.select("id", scorer(F.col("text")).alias("s")).collect()}
    assert all(math.isclose(sum(s), 1.0) for s in got.values()) and len(got) == 404
    rows = texts()
    right = [max(zip(got[i], scoring.SCORES, strict=True))[1] == tone for i, t, tone in rows if tone and t and re.search("[a-z]", t)]
    assert sum(right) / len(right) > 0.95
    assert got[403][0] > 0.9  # one word, 20,000 times
    # by hand: shares of buckets, one linear layer, softmax
    for i, t, _ in rows[:20]:
        words = re.findall(r"[^\W\d_]+", t.lower())
        z = model.biases + sum(model.weights[:, model._bucket(w)] for w in words) / len(words)
        assert np.allclose(got[i], np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    buckets = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in (*GOOD, *BAD, "ä" * 100)], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(512)).alias("b")).collect()}
    assert all(model._bucket(w) == b for w, b in buckets.items())


def test_the_model_is_kept_and_read(spark, items, tmp_path):
    model = scoring.fit_text_model(items, "text", "tone", buckets=64)
    model.save(spark, f"{tmp_path}/m")
    again = scoring.TextModel.read(spark, f"{tmp_path}/m")
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.biases, model.biases)
    two = scoring.fit_text_model(items.where("tone != 'neu'"), "text", "tone", buckets=64)
    assert (two([["rise"], []])[:, 2] < 1e-6).all()


def test_daily_sentiment_takes_any_scorer(spark, items):
    rows = items.select(F.lit("s").alias("symbol"), F.lit(day(0)).alias("trading_date"), F.col("id").cast("string").alias("article_id"), F.lit(dt.datetime(2024, 1, 1)).alias("published_at"), "text")
    fixed = scoring.score_with(lambda: lambda batch: [[0.5, 0.25, 0.25]] * len(batch))
    r = news.sentiment_daily(rows, scorer=fixed).collect()
    assert [(x["sent_pos"], x["sent_spread"], x["articles_used"], x["news_count"]) for x in r] == [(0.5, 0.25, 32, 404)]


def lexicon_by_hand(rows, least):
    known = [(set(re.findall(r"[^\W\d_]+", (t or "").lower())), tone) for _, t, tone in rows if tone]
    df, out = Counter(w for ws, _ in known for w in ws), {}
    for w, n in df.items():
        if n >= least:
            out[w] = []
            for c in ("pos", "neg"):
                a, na = sum(w in ws for ws, tone in known if tone == c), sum(tone == c for _, tone in known)
                out[w].append(max(0.0, math.log((a + 0.5) / (na + 1)) - math.log((n - a + 0.5) / (len(known) - na + 1))))
    return out


@pytest.mark.parametrize("bound", [1_000_000, 2])
def test_lexicon_scores_equal_a_loop_with_a_small_and_a_large_lexicon(spark, items, monkeypatch, bound):
    monkeypatch.setattr(scoring, "bounded_broadcast", lambda df: bounded_broadcast(df, bound))
    lexicon = scoring.learn_lexicon(items, "text", "tone")
    weights = lexicon_by_hand(texts(), 5)
    assert {r["word"]: [r["pos"], r["neg"]] for r in lexicon.collect()} == {w: pytest.approx(v) for w, v in weights.items()}
    got = {r["id"]: (r["pos"], r["neg"], r["neu"]) for r in scoring.lexicon_scores(items, lexicon, "id", "text").collect()}
    assert len(got) == 404
    for i, t, _ in texts():
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        z = [10 * sum(weights.get(w, (0, 0))[c] for w in words) / max(1, len(words)) for c in (0, 1)] + [1.0]
        e = [math.exp(v - max(z)) for v in z]
        assert got[i] == pytest.approx([v / sum(e) for v in e])


# --- windows ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lagged(spark):
    """y follows the x of five rows before."""
    rng = random.Random(7)
    rows = []
    for s in ("a", "b"):
        x = [rng.gauss(0, 0.01) for _ in range(300)]
        rows += [(s, day(i), x[i], rng.gauss(0, 0.01), 0.8 * x[i - 5] + rng.gauss(0, 1e-4) if i >= 5 else 0.0) for i in range(300)]
    rows.append(("a", day(300), 0.0, None, None))
    return spark.createDataFrame(rows, "symbol string, date date, x double, z double, y double").cache()


def test_a_planted_lag_is_found_by_a_linear_model_on_flat_windows(spark, lagged):
    w = models.windowed(lagged, ["x", "z"], "y", 10)
    model = models.train_regressor(w, "x", "y")
    weights = model.stages[-1].coefficients.toArray()
    assert weights.argmax() == (10 - 5) * 2 and abs(weights[10] - 0.8) < 0.05
    marked = ev.chronological_split(w)
    scored = models.predict(model, marked.where("split = 'test'"), "x")
    assert scored.agg(F.corr("pred_ret", "y")).first()[0] > 0.99


def test_windows_with_nulls_go_and_unlabelled_ones_stay_for_prediction(spark, lagged):
    labelled, every = models.windowed(lagged, ["x", "z"], "y", 10), models.windowed(lagged, ["x", "z"], "y", 10, labelled=False)
    assert labelled.count() == 580 and every.count() == 581
    assert every.where("y is null").count() == 1
    gap = lagged.withColumn("x", F.when(F.col("date") != day(50), F.col("x")))
    assert models.windowed(gap, ["x", "z"], "y", 10).count() == 580 - 20


def test_pooled_windows_hold_mean_deviation_last_and_change(spark, lagged):
    r = models.windowed(lagged, ["x", "z"], "y", 10, "pooled").where(F.col("symbol") == "a").orderBy("date").first()
    rows = lagged.where("symbol = 'a'").orderBy("date").limit(10).collect()
    want = []
    for c in ("x", "z"):
        v = np.array([x[c] for x in rows])
        want += [v.mean(), v.std(), v[-1], v[-1] - v[0]]
    assert np.allclose(r["x"].toArray(), want)


def test_ablation_and_retraining_take_windows(spark, lagged, tmp_path):
    flat = models.windowed(lagged, ["x", "z"], "y", 10)
    both = flat.join(models.windowed(lagged, ["x", "z"], "y", 10, "pooled").select("symbol", "date", F.col("x").alias("pooled")), ["symbol", "date"])
    m = {r["features"]: r for r in models.ablation(both, {"flat": "x", "pooled": "pooled"}, "y").collect()}
    assert m["flat"]["rmse"] < 0.5 * m["pooled"]["rmse"] and m["flat"]["n"] == m["pooled"]["n"]
    log = models.retrain_recent(flat, "x", "y", f"{tmp_path}/models", "v1", days=200).first()
    assert log["status"] == "fitted" and log["hit_rate"] > 0.9


def test_the_fit_reads_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    rows = [(f"good{i % 3} fine", "pos") if i % 2 else (f"bad{i % 3} poor", "neg") for i in range(40)]
    items = spark.createDataFrame(rows, "text string, tone string").withColumn("text", F.udf(counted, "string")("text"))
    scoring.fit_text_model(items, "text", "tone", buckets=64, rounds=3)
    assert seen.value == 40


def test_items_of_one_time_and_without_a_time_count_up_to_the_limit(spark):
    """Of equal and missing times the larger ids count, and a group smaller than the limit whole."""
    rows = [("S", f"{i:02d}", "1998-01-05 10:00:00" if i < 6 else None, "thing" if i in (4, 5) else "thble") for i in range(9)] + [("T", "a", None, "thing"), ("T", "b", None, "thble")]
    items = spark.createDataFrame(rows, "symbol string, article_id string, at string, text string").selectExpr("symbol", "date'1998-01-05' AS trading_date", "article_id", "timestamp(at) AS published_at", "text")
    for limit, used, pos in ((2, 2, True), (7, 7, False)):
        got = {r["symbol"]: r for r in news.sentiment_daily(items, limit).collect()}
        assert got["S"]["articles_used"] == used and got["S"]["news_count"] == 9 and got["T"]["articles_used"] == 2 and (got["S"]["sent_spread"] > 0) == pos
