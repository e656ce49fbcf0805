"""Exact quantiles by ranges against the exact percentile."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev, stats

PS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed", "one", "two"])
def test_quantiles_equal_the_exact_percentile(spark, kind):
    rng = random.Random(1)
    make = {"spread": rng.random, "ties": lambda: float(rng.choice([1, 1, 1, 1, 2, 3])), "skewed": lambda: 10 ** rng.uniform(-300, 300), "one": lambda: 7.0, "two": rng.random}[kind]
    n = {"one": 1, "two": 2}.get(kind, 3000)
    rows = [(rng.choice(["a", "a", "b", None]) if n > 2 else "a", make(), None if rng.random() < 0.2 and n > 2 else -make(), None) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    got = {(r["g"], r["column"], r["probability"]): r["value"] for r in stats.exact_quantiles(df, ["x", "y", "z"], PS, ["g"]).collect()}
    want = {}
    for r in df.groupBy("g").agg(*[F.percentile(c, F.array(*[F.lit(p) for p in PS])).alias(c) for c in "xyz"]).collect():
        for c in "xyz":
            if r[c] is not None:
                want |= {(r["g"], c, p): v for p, v in zip(PS, r[c], strict=True)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_no_task_orders_more_than_its_range(spark):
    """Of 64,000 distinct values only the ranges of the wanted ranks are ordered, each a small part."""
    df = spark.range(64_000).select((F.col("id") * 0.5).alias("x"))
    out = stats.exact_quantiles(df, ["x"], [0.5]).first()
    assert out["value"] == 31_999.5 / 2
    plan = stats.exact_quantiles(df, ["x"], [0.5])._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_scaling_with_exact_quartiles_and_empty_fits(spark):
    df = spark.createDataFrame([(i, float(i), 3.0, None) for i in range(9)], "i int, a double, b double, c double")
    r = ev.robust_scale(df, ["a", "b", "c"], df).orderBy("i").collect()
    assert [x["a"] for x in r] == [(i - 4) / 4 for i in range(9)] and {x["b"] for x in r} == {0.0} and {x["c"] for x in r} == {None}
    assert {x["a"] for x in ev.robust_scale(df, ["a"], df.limit(0)).collect()} == {None}
    assert stats.exact_quantiles(df.limit(0), ["a"], [0.5]).count() == 0
