"""Refits by running sums, positions over time: against loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev, portfolio, walkforward


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = []
    for d in range(80):
        for s in range(4):
            a, b = rng.gauss(100, 2), rng.gauss(0, 1e-3)
            y = 0.01 * (a - 100) - 3 * b + rng.gauss(0, 0.005) + (0.02 if d > 50 else 0)
            rows.append((f"s{s}", day(d * 2), a, None if (d + s) % 11 == 0 else b, 7.0, y))
    return spark.createDataFrame(rows, "symbol string, date date, a double, b double, c double, y double"), rows


def fitted(rows, upto, first=None, cols=(2, 3)):
    known = [r for r in rows if r[1] <= upto and (first is None or r[1] >= first) and all(r[c] is not None for c in (*cols, 5))]
    x = np.array([[1.0, *(r[c] for c in cols)] for r in known])
    return np.linalg.lstsq(x, np.array([r[5] for r in known]), rcond=None)[0], len(known)


@pytest.mark.parametrize("span", [None, 15])
def test_fits_equal_those_of_each_fold(panel, span):
    df, rows = panel
    folds = ev.walk_forward_folds(df.select("date").distinct(), 30, 10, 10)
    got = {r["train_end"]: r for r in walkforward.fold_fits(df, folds, ["a", "b"], "y", span=span).join(folds.select("fold", "train_end"), "fold").collect()}
    assert len(got) == 5
    dates = sorted({r[1] for r in rows})
    for end, r in got.items():
        want, n = fitted(rows, end, None if span is None else dates[dates.index(end) - span + 1])
        assert r["n_train"] == n
        assert np.allclose(r["coefficients"], want, rtol=1e-6, atol=1e-9)


def test_a_constant_feature_gets_no_weight_and_ridge_shrinks(panel):
    df, _ = panel
    folds = ev.walk_forward_folds(df.select("date").distinct(), 30, 10, 10)
    plain = walkforward.fold_fits(df, folds, ["a", "b"], "y").orderBy("fold").first()["coefficients"]
    extra = walkforward.fold_fits(df, folds, ["a", "b", "c"], "y").orderBy("fold").first()["coefficients"]
    small = walkforward.fold_fits(df, folds, ["a", "b"], "y", ridge=1.0).orderBy("fold").first()["coefficients"]
    assert extra[3] == 0 and np.allclose(extra[:3], plain)
    assert 0 < abs(small[1]) < abs(plain[1]) and 0 < abs(small[2]) < abs(plain[2])


def test_walk_forward_scores_each_fold_with_its_own_fit(panel):
    df, rows = panel
    out = walkforward.walk_forward(df, {"one": ["a"], "both": ["a", "b"]}, "y", {"one": 0.25, "both": 0.75}, train=30, test=10, step=10).orderBy("fold").collect()
    dates = sorted({r[1] for r in rows})
    assert [r["fold"] for r in out] == [1, 2, 3, 4, 5]
    for r in out:
        at = dates.index(r["test_start"])
        assert dates[at - 1] == r["train_end"] and dates[at + 9] == r["test_end"]
        one, both = fitted(rows, r["train_end"], cols=(2,))[0], fitted(rows, r["train_end"])[0]
        tested = [x for x in rows if r["test_start"] <= x[1] <= r["test_end"] and x[3] is not None]
        p1 = np.array([one @ [1, x[2]] for x in tested])
        p2 = np.array([both @ [1, x[2], x[3]] for x in tested])
        y = np.array([x[5] for x in tested])
        assert r["n_test"] == len(tested) and r["n_train"] == fitted(rows, r["train_end"])[1]
        assert math.isclose(r["rmse_one"], np.sqrt(((p1 - y) ** 2).mean()), rel_tol=1e-6)
        assert math.isclose(r["mae_both"], abs(p2 - y).mean(), rel_tol=1e-6)
        assert math.isclose(r["ic_ens"], np.corrcoef(0.25 * p1 + 0.75 * p2, y)[0, 1], rel_tol=1e-5)
    means = {(m["metric"], m["model"]): m for m in walkforward.fold_means(walkforward.walk_forward(df, {"one": ["a"]}, "y", train=30, test=10, step=10)).collect()}
    assert set(means) == {(m, "one") for m in walkforward.METRICS}
    plain = walkforward.walk_forward(df, {"one": ["a"]}, "y", train=30, test=10, step=10).collect()
    assert math.isclose(means["hit_rate", "one"]["mean"], sum(r["hit_rate_one"] for r in plain) / 5, rel_tol=1e-9)


def test_overlapping_folds_and_few_rows(panel):
    df, _ = panel
    assert walkforward.walk_forward(df, {"one": ["a"]}, "y", train=30, test=10, step=5).count() == 9
    assert walkforward.walk_forward(df, {"one": ["a"]}, "y", train=30, test=10, step=10, least=1000).count() == 0
    assert walkforward.walk_forward(df.limit(0), {"one": ["a"]}, "y").count() == 0


TRADES = "symbol string, date date, signal string, position_size double, entry_price double, exit_date date, exit_price double, actual_ret double, status string"


def trades(spark):
    rows = [("x", day(1), "LONG", 0.1, 100.0, day(4), 110.0), ("y", day(2), "SHORT", 0.05, 50.0, None, None), ("x", day(4), "SHORT", 0.1, 110.0, day(6), 99.0),
            ("z", day(3), "LONG", 0.1, 10.0, day(3), 10.0), ("w", day(0), "LONG", 0.1, 5.0, day(2), 6.0), ("late", day(40), "LONG", 0.1, 5.0, None, None)]
    full = [(*r, round(math.log(r[6] / r[4]), 8) if r[6] else None, "closed" if r[5] else "open") for r in rows]
    return spark.createDataFrame(full, TRADES), full


DATES = [day(n) for n in (1, 2, 4, 5, 7)]  # neither the first entry nor day 3 or 6 is a date
PRICES = [("x", day(1), 100.0), ("x", day(2), 104.0), ("y", day(2), 51.0), ("y", day(4), 47.0), ("x", day(5), 90.0), ("y", day(6), 40.0)]


def test_open_positions_equal_a_loop_over_days(spark):
    df, rows = trades(spark)
    got = sorted((r["date"], r["symbol"], r["entry_date"]) for r in portfolio.open_positions(df, spark.createDataFrame([(d,) for d in [*DATES, None, DATES[0]]], "date date")).collect())
    at = lambda d: next((i for i, x in enumerate(DATES) if x >= d), len(DATES))
    want = sorted((d, r[0], r[1]) for i, d in enumerate(DATES) for r in rows if at(r[1]) <= i and (r[5] is None or i < at(r[5])))
    assert got == want


@pytest.mark.parametrize("stale", [None, 3])
def test_valuation_equals_a_loop_over_days(spark, stale):
    df, rows = trades(spark)
    prices = spark.createDataFrame(PRICES, "symbol string, date date, close double")
    got = {r["date"]: r for r in portfolio.daily_valuation(df, prices, spark.createDataFrame([(d,) for d in DATES], "date date"), stale_days=stale).collect()}
    known, before = {(s, d): c for s, d, c in PRICES}, 1e6
    assert sorted(got) == DATES
    at = lambda d: next((i for i, x in enumerate(DATES) if x >= d), len(DATES))
    for i, d in enumerate(DATES):
        won = sum(1e6 * r[3] * ((1 if r[2] == "LONG" else -1) * r[7] - 0.002) for r in rows if r[5] and r[5] <= d)
        gain, n = 0.0, 0
        for r in rows:
            if at(r[1]) <= i and (r[5] is None or i < at(r[5])):
                price = next((known[r[0], d - dt.timedelta(days=k)] for k in range((stale or 0) + 1) if (r[0], d - dt.timedelta(days=k)) in known), r[4])
                gain += 1e6 * r[3] * (1 if r[2] == "LONG" else -1) * math.log(price / r[4])
                n += 1
        r = got[d]
        assert math.isclose(r["realised"], won, abs_tol=0.02) and math.isclose(r["unrealised"], gain, abs_tol=0.02) and r["open_positions"] == n
        assert math.isclose(r["portfolio_value"], 1e6 + won + gain, abs_tol=0.03) and math.isclose(r["daily_return"], (1e6 + won + gain) / before - 1, abs_tol=1e-6)
        before = 1e6 + won + gain


def test_valuation_without_trades_or_dates(spark):
    df, _ = trades(spark)
    prices = spark.createDataFrame(PRICES, "symbol string, date date, close double")
    dates = spark.createDataFrame([(d,) for d in DATES], "date date")
    assert {r["portfolio_value"] for r in portfolio.daily_valuation(df.limit(0), prices, dates).collect()} == {1e6}
    assert portfolio.daily_valuation(df, prices, dates.limit(0)).where(F.col("date").isNotNull()).count() == 0
