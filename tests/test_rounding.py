"""Figures are rounded once, and in binary, as the SQL rounds them."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import portfolio


def test_halves_are_rounded_as_in_sql(spark):
    values = [i / 2e5 * s for i in range(1, 4001) for s in (1, -1)] + [0.0]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(tx.half_away(F.col("v"), 4).alias("x")).collect()]
    con = duckdb.connect()
    want = [x for (x,) in con.execute("SELECT round(v, 4) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
    assert got == want


def test_sizes_of_positions_are_rounded_as_in_sql(spark):
    z = [i * 1e-6 for i in range(100_100, 200_000, 100)]
    rows = spark.createDataFrame([(v, 1.0, 1.0) for v in z], "pred_ret double, vol_20d double, close double")
    got = [r["position_size"] for r in portfolio.signals(rows, threshold=0.05).collect()]
    want = [x for (x,) in duckdb.connect().execute("SELECT round(least(abs(round(v, 6)) / 2, 0.10), 4) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [z]).fetchall()]
    assert got == want


def test_metrics_are_rounded_once(spark):
    day = dt.date(2024, 1, 1)
    snaps = spark.createDataFrame([(day, 1_000_000.0, 0.0, 0.0, 0.0, 1, 1, 0), (day + dt.timedelta(1), 1_000_000.0, 0.0, 0.00012346, 1.4999, 1, 1, 0)],
                                  "date date, portfolio_value double, daily_pnl double, daily_return double, transaction_costs double, open_positions long, longs long, shorts long")
    trades = spark.createDataFrame([("closed", 1.0)], "status string, pnl_net double")
    row = portfolio.portfolio_metrics(snaps, trades, digits={"total_costs": 0, "today_return_pct": 3}).first()
    assert row["total_costs"] == 1.0 and row["today_return_pct"] == 0.012 and row["total_trades"] == 1.0
