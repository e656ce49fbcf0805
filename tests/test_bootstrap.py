"""The bootstrap by sums against numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev


def test_draws_equal_numpy_and_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0.1, 1.0)) for i in range(500)]
    df = spark.createDataFrame([*rows, (900, None)], "k int, x double")
    got = [ev.bootstrap_moments(df.repartition(n), "x", ["k"], ev.sharpe_of_sums, draws=200).first() for n in (1, 5)]
    h = np.array([r["h"] for r in df.where("x is not null").select(F.xxhash64(F.lit(42), "k", "x").alias("h")).orderBy("k").collect()])
    x, stats = np.array([v for _, v in rows]), []
    hashes = {r["k"]: r["h"] for r in df.where("x is not null").select("k", F.xxhash64(F.lit(42), "k", "x").alias("h")).collect()}
    h = np.array([hashes[i] for i, _ in rows])
    for d in range(200):
        w = np.repeat(x, ev.draw_counts(h, d))
        stats.append(w.mean() / w.std(ddof=1) * math.sqrt(252))
    for r in got:
        assert math.isclose(r["estimate"], x.mean() / x.std(ddof=1) * math.sqrt(252), rel_tol=1e-9)
        assert math.isclose(r["low"], np.quantile(stats, 0.025), rel_tol=1e-6) and math.isclose(r["high"], np.quantile(stats, 0.975), rel_tol=1e-6)
        assert math.isclose(r["std_error"], np.std(stats, ddof=1), rel_tol=1e-6)


def test_numbers_of_a_draw_are_poisson():
    h = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 200_000)
    n = ev.draw_counts(h, 17)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02 and abs((n == 0).mean() - math.exp(-1)) < 0.005
    assert abs(np.corrcoef(n, ev.draw_counts(h, 18))[0, 1]) < 0.01


def test_few_or_no_values(spark):
    one = ev.bootstrap_moments(spark.createDataFrame([(1, 2.0)], "k int, x double"), "x", ["k"], ev.sharpe_of_sums, draws=20).first()
    assert one["estimate"] == 0.0 and one["low"] == 0.0
    none = ev.bootstrap_moments(spark.createDataFrame([], "k int, x double"), "x", ["k"], lambda n, s1, s2: s1 / n, draws=20).first()
    assert none["estimate"] is None and none["low"] is None
