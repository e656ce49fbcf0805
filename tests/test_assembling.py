"""Assembly, factor legs, portfolio figures and readers on small tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import assembly, evaluation as ev, portfolio, readers, writes


def d(text):
    return dt.date.fromisoformat(text)


def test_feature_matrix_fills_and_skips(spark):
    grid = spark.createDataFrame([("A", d("2024-03-18")), ("A", d("2024-03-21")), ("B", d("2024-03-18")), ("A", d("2024-03-15"))], "symbol string, date date")
    sent = spark.createDataFrame([("A", d("2024-03-15"), 0.8, 0.1, 0.1, 0.7, 4)], "symbol string, trading_date date, sent_pos double, sent_neg double, sent_neu double, sent_spread double, news_count long")
    tech = spark.createDataFrame([("A", d("2024-03-18"), *[float(k) for k in range(9)])], "symbol string, date date, " + ", ".join(f"{c} double" for c in assembly.TECHNICAL))
    out = {(r["symbol"], str(r["date"])): r for r in assembly.feature_matrix(grid, sent, tech, existing=grid.where("date = '2024-03-15'")).collect()}
    assert set(out) == {("A", "2024-03-18"), ("A", "2024-03-21"), ("B", "2024-03-18")}
    monday = out["A", "2024-03-18"]  # Friday's news
    assert (monday["sent_pos"], monday["news_count"], monday["dow_mon"], monday["ma_20"], monday["target_ret_1d"]) == (0.8, pytest.approx(math.log(5)), 1.0, 1.0, None)
    late, other = out["A", "2024-03-21"], out["B", "2024-03-18"]
    assert late["sent_pos"] == other["sent_pos"] == pytest.approx(1 / 3) and late["sent_spread"] == 0.0 and late["news_count"] == 0.0 and other["ma_20"] is None
    assert assembly.feature_matrix(grid, sent.limit(0), tech.limit(0)).count() == 4 and assembly.feature_matrix(grid.limit(0), sent, tech).count() == 0
    assert len(assembly.MODEL) == 17


def test_wide_prices(spark):
    wide = spark.createDataFrame([(dt.datetime(2024, 1, 2, 9), 1.00004, 5, None, 7), (dt.datetime(2024, 1, 3, 9), 2.0, None, 3.0, None)], "at timestamp, ac double, av long, bc double, bv long")
    out = assembly.wide_prices_to_bars(wide, "at", {("A", "close"): "ac", ("A", "volume"): "av", ("B", "close"): "bc", ("B", "volume"): "bv"}).collect()
    assert sorted((r["symbol"], str(r["date"]), r["close"], r["volume"]) for r in out) == [("A", "2024-01-02", 1.0, 5), ("A", "2024-01-03", 2.0, 0), ("B", "2024-01-03", 3.0, 0)]


def test_run_audit_and_backfill(spark):
    runs = spark.createDataFrame([(1, "running", None), (2, "running", None)], "run_id long, status string, finished_at date")
    done = spark.createDataFrame([(1, "failed", d("2024-01-01")), (1, "success", d("2024-01-02")), (9, "success", d("2024-01-02"))], "run_id long, status string, finished_at date")
    assert sorted((r["run_id"], r["status"]) for r in assembly.run_audit(runs, done).collect()) == [(1, "success"), (2, "running")]
    plan = assembly.backfill_plan(spark.createDataFrame([("a",), ("a",), ("b",)], "source string"), "2024-12-23", "2025-01-08", spark.createDataFrame([("a|2024-W52",)], "key string")).collect()
    assert sorted((r["key"], str(r["week_end"])) for r in plan) == [("a|2025-W01", "2025-01-05"), ("a|2025-W02", "2025-01-08"), ("b|2024-W52", "2024-12-29"), ("b|2025-W01", "2025-01-05"), ("b|2025-W02", "2025-01-08")]


def test_portfolio_metrics_and_ratios(spark):
    values = [100.0, 110.0, 105.0, 95.0, 100.0, 120.0]
    rows = [(d(f"2024-01-0{i + 1}"), v, 1.0, v / values[max(i - 1, 0)] - 1, 2.0, 3, 2, 1) for i, v in enumerate(values)]
    snaps = spark.createDataFrame(rows, "date date, portfolio_value double, daily_pnl double, daily_return double, transaction_costs double, open_positions long, longs long, shorts long")
    trades = spark.createDataFrame([("closed", 30.0), ("closed", -10.0), ("open", None)], "status string, pnl_net double")
    m = portfolio.portfolio_metrics(snaps, trades, capital=100.0).first()
    assert (m["total_return_pct"], m["max_drawdown_pct"], m["hit_rate_pct"], m["win_loss_ratio"], m["total_costs"], m["trading_days"]) == (20.0, -13.64, 50.0, 3.0, 12.0, 6.0)
    assert m["calmar_ratio"] == pytest.approx((1.2 ** (252 / 6) - 1) / (15 / 110), rel=1e-3)
    assert set(portfolio.portfolio_metrics(snaps.limit(0), trades).first()) == {0.0} and len(m) == 20


def test_daily_close_out_against_a_loop(spark):
    rng = random.Random(3)
    day = d("2024-01-05")
    for cash in (150.0, 1_000.0, 1e6):
        open_ = [(f"S{i}", rng.choice(["LONG", "SHORT"]), 100.0, 50.0 * i) for i in range(4)]
        prices = [(f"S{i}", day, rng.uniform(90, 110)) for i in range(1, 12)]
        sigs = [(f"S{i}", day, rng.choice(["LONG", "SHORT", "FLAT"]), round(rng.uniform(0, 0.3), 4), rng.uniform(-2, 2)) for i in range(12)]
        price = {s: p for s, _, p in prices}
        value, have, pnl = 5_000.0, cash, 0.0
        for s, side, entry, alloc in open_:
            if s in price:
                got = alloc * (1 if side == "LONG" else -1) * math.log(price[s] / entry) - alloc * 0.002
                have, value, pnl = have + alloc + got, value + got, pnl + got
        want = {}
        for s, _, side, size, z in sorted(sigs, key=lambda x: (-abs(x[4]), x[0])):
            alloc = min(value * size, have)
            if side != "FLAT" and s in price and alloc >= 100:
                want[s] = alloc
                have -= alloc
        _, opened, snap = portfolio.daily_close_out(spark.createDataFrame(open_, "symbol string, signal string, entry_price double, capital_allocated double"),
                                                    spark.createDataFrame(sigs, "symbol string, date date, signal string, position_size double, z_score double"),
                                                    spark.createDataFrame(prices, "symbol string, date date, close double"), str(day), 5_000.0, cash)
        assert {r["symbol"]: r["capital_allocated"] for r in opened.collect()} == pytest.approx(want)
        s = snap.first()
        assert (s["portfolio_value"], s["cash"], s["daily_pnl"]) == pytest.approx((value, have, pnl), abs=0.01) and s["open_positions"] == len(want) + 1


def test_student_tails():
    known = {(2.228139, 10): 0.05, (1.0, 1): 0.5, (0.0, 7): 1.0, (12.706205, 1): 0.05, (1.959964, 1e7): 0.05, (3.169273, 10): 0.01, (0.1, 30): 0.9210096}
    for (t, n), p in known.items():
        assert ev._student_tail(t, n) == pytest.approx(p, abs=2e-6)
    assert ev._student_tail(math.inf, 3) == 0.0


def test_drift_halves_split_ties_inside_one_date(spark):
    rows = [("2024-01-01", 0.0)] * 3 + [("2024-01-02", float(k)) for k in range(10)] + [("2024-01-03", 9.0)] * 2 + [("2024-01-04", None)]
    df = spark.createDataFrame([(d(a), x) for a, x in rows], "date date, sent_spread double")
    flat = sorted((a, x) for a, x in rows if x is not None)
    half = len(flat) // 2
    from tidemark.operators import stats

    want = stats.histogram_kl(spark.createDataFrame([(int(i >= half), x) for i, (_, x) in enumerate(flat)], "side int, x double")).first()["kl"]
    got = ev.drift_check(df, least=5).first()
    assert got["value"] == pytest.approx(want) and got["n"] == 15
    assert ev.drift_check(df.limit(0)).first()["status"] == "insufficient_data"


def test_writers_with_repeated_keys(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, at long")
    batch = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1), (3, "d", 0)], "k long, v string, at long")
    newest = [F.desc("at"), "v"]
    assert sorted((r["k"], r["v"]) for r in writes.upsert(table, batch, ["k"], newest).collect()) == [(1, "a"), (2, "new"), (3, "c")]
    assert sorted((r["k"], r["v"]) for r in writes.insert_or_ignore(table, batch, ["k"], newest).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted((r["k"], r["v"]) for r in writes.update_from(table, batch, ["k"], ["v"], newest).collect()) == [(1, "a"), (2, "new")]


def test_log_files(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", "x", 1.0), ("2024-01-02", None, None)], "at string, name string, value double")
    path = str(tmp_path / "log")
    readers.append_jsonl(rows, path)
    readers.append_jsonl(rows.limit(1), path)
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    assert readers.read_jsonl(spark, path, rows.schema).count() == 3
    assert [r["at"] for r in readers.read_jsonl(spark, path, rows.schema, last=1).collect()] == ["2024-01-02"]
    readers.append_csv(rows, str(tmp_path / "csv"))
    readers.append_csv(rows, str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv"), "at date, name string, value double")
    assert back.count() == 4 and dict(back.dtypes)["at"] == "date"


def test_display_and_filters(spark):
    rows = spark.createDataFrame([("A", d("2024-01-01"), "open", "abcdef"), ("B", d("2024-01-09"), "closed", None), ("A", d("2024-01-10"), "closed", "xyz")], "symbol string, date date, status string, id string")
    pick = lambda **k: sorted((r["symbol"], str(r["date"])) for r in readers.filter_trades(rows, **k).collect())
    assert pick(status="closed", symbol="A") == [("A", "2024-01-10")] and pick(as_of="2024-01-09", days=2) == [("B", "2024-01-09")] and pick(limit=1) == [("A", "2024-01-10")] and len(pick()) == 3
    assert [r["id"] for r in readers.display_columns(rows, ids={"id": 3}).collect()] == ["abc", None, "xyz"]
    assert [r["s"] for r in spark.createDataFrame([(0.0001,), (0.005,), (0.03,), (0.2,), (None,)], "p double").select(assembly.significance(F.col("p")).alias("s")).collect()] == ["***", "**", "*", "", ""]
    assert readers.latest_snapshot(rows).first()["id"] == "xyz" and readers.latest_snapshot(rows.limit(0)).count() == 0
