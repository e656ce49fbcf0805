"""Market operators on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, portfolio, timeseries as ts, writes


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def bars_of(spark, closes):
    return spark.createDataFrame([("A", day(i), float(c), float(c), float(c), float(c), 100) for i, c in enumerate(closes)],
                                 "symbol string, date date, open double, high double, low double, close double, volume long")


def test_rsi_edges(spark):
    last = lambda c: bars_of(spark, c).select("date", ts.rsi_wilder().alias("r")).orderBy(F.desc("date")).first()["r"]
    assert last([100] * 30) == 50.0 and last(range(100, 130)) == 100.0 and last([100] * 5) is None


@pytest.mark.parametrize("n, days", [(14, 120), (3, 20)])
def test_rsi_by_window_sums_equals_the_fold(spark, n, days):
    """Over several blocks, with missing dates, null closes, runs without change, and two symbols."""
    draw = random.Random(n)
    rows, price = [], 50.0
    for i in range(700):
        price = max(1.0, price + draw.choice([0.0, 0.0, 1.0, -1.0, draw.gauss(0, 2)])) if i % 100 < 70 else price
        if draw.random() < 0.8:
            rows += [(s, day(i), None if draw.random() < 0.05 else price * f) for s, f in (("A", 1.0), ("B", 0.5))]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = ts.with_rsi(bars, n, days).select("*", ts.rsi_wilder(n, days).alias("fold"))
    at = [(r["symbol"], r["date"], r["rsi_14"], r["fold"]) for r in got.collect() if r["close"] is not None]
    assert len(at) > 900 and sum(f is not None for *_, f in at) > 400
    for symbol, date, value, fold in at:
        assert (value is None) == (fold is None) and (fold is None or abs(value - fold) < 2e-4), (symbol, date, value, fold)


def test_bollinger_stays_in_range_and_no_row_without_history(spark):
    b = bars_of(spark, [100 + (i % 5 - 2) * 0.5 for i in range(30)])
    got = [r[0] for r in b.select(ts.bollinger_position()).collect()]
    assert all(-0.5 <= x <= 1.5 for x in got if x is not None) and got.count(None) == 19
    assert ts.technical_features(b).count() == 0 and ts.technical_features(b, min_history=25).count() == 6


def test_indicators_do_not_look_ahead(spark):
    closes = [100 + (i * 7 % 13) for i in range(80)]
    whole = {r["date"]: r for r in ts.technical_features(bars_of(spark, closes)).collect()}
    for r in ts.technical_features(bars_of(spark, closes[:70])).collect():
        assert r == whole[r["date"]]


def test_drawdown(spark):
    got = bars_of(spark, [100, 110, 105, 95, 100, 120]).select(ts.drawdown().alias("d")).agg(F.min("d")).first()[0]
    assert got == pytest.approx(95 / 110 - 1)


def test_session_date(spark):
    sessions = spark.createDataFrame([(dt.date(2024, 3, 15),), (dt.date(2024, 3, 18),), (dt.date(2024, 3, 19),)], "session_date date")
    items = spark.createDataFrame([("a", dt.datetime(2024, 3, 18, 10, 30)), ("b", dt.datetime(2024, 3, 18, 10, 0)), ("c", dt.datetime(2024, 3, 16, 3, 0)), ("d", None)], "id string, published_at timestamp")
    got = {r["id"]: r["trading_date"] for r in joins.assign_session_date(items, sessions).collect()}
    assert got == {"a": dt.date(2024, 3, 19), "b": dt.date(2024, 3, 18), "c": dt.date(2024, 3, 18), "d": None}


def test_asof_takes_friday_for_monday(spark):
    rows = spark.createDataFrame([("A", dt.date(2024, 3, 15), 0.7)], "symbol string, date date, v double")
    probes = spark.createDataFrame([("A", dt.date(2024, 3, 18)), ("A", dt.date(2024, 3, 25)), ("B", dt.date(2024, 3, 18))], "symbol string, date date")
    got = {(r["symbol"], r["date"].day): r["v"] for r in joins.asof_backward(probes, rows, ["v"]).collect()}
    assert got == {("A", 18): 0.7, ("A", 25): None, ("B", 18): None}


def test_writers_are_idempotent(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, writes.insert_new(table, batch, ["k"]).collect())) == [(3, "y")]
    once = writes.upsert(table, batch, ["k"])
    assert sorted(map(tuple, writes.upsert(once, batch, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert writes.insert_new(writes.insert_or_ignore(table, batch, ["k"]), batch, ["k"]).count() == 0


def test_tags_take_the_longest_alias(spark):
    items = spark.createDataFrame([("1", "Reliance Industries beat; RIL up"), ("2", "relianced ril_x"), ("3", None)], "article_id string, t string")
    got = joins.tag_symbols(items, [("reliance", "R"), ("reliance industries", "R"), ("ril", "R")], F.col("t")).collect()
    assert [(r["article_id"], r["match_keyword"]) for r in got] == [("1", "reliance industries")]


def test_signals(spark):
    rows = spark.createDataFrame([("A", day(0), 100.0, 1.0, 0.8), ("B", day(0), 100.0, 1.0, -0.9), ("C", day(0), 100.0, 1.0, 0.2)], "symbol string, date date, close double, vol_20d double, pred_ret double")
    got = {r["symbol"]: (r["signal"], r["position_size"]) for r in portfolio.signals(rows).collect()}
    assert got == {"A": ("LONG", 0.1), "B": ("SHORT", 0.1), "C": ("FLAT", 0.0)}


def test_registered_queries_have_known_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 55
