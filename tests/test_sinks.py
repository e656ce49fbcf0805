"""Upserts by partition and run counters."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sinks

ROWS = "k int, part int, v string"


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def put(spark, path, rows, **more):
    sinks.upsert_partitions(spark.createDataFrame(rows, ROWS), path, ["k"], ["part"], **more)


def content(spark, path):
    return sorted(((r["k"], r["part"], r["v"]) for r in spark.read.parquet(path).collect()), key=str)


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, [(k, k % 4, "old") for k in range(40)])
    before = files(path)
    batch = [(1, 1, "new"), (41, 1, "new")]
    put(spark, path, batch)
    after = files(path)
    assert {f for f in before if "part=1/" not in f} == {f for f in after if "part=1/" not in f and before.get(f) == after[f]}
    assert content(spark, path) == sorted([(k, k % 4, "new" if k == 1 else "old") for k in range(40)] + [(41, 1, "new")], key=str)
    put(spark, path, batch)  # once more
    assert content(spark, path).count((41, 1, "new")) == 1 and len(content(spark, path)) == 41
    assert {f for f in before if "part=1/" not in f} <= set(files(path))


def test_empty_batches_nulls_and_several_rows_of_a_key(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, [(1, 1, "a"), (None, None, "n"), (2, None, "b")])
    put(spark, path, [])
    put(spark, path, [(None, None, "m"), (3, 1, "x"), (3, 1, "y")], newest=[F.desc("v")])
    assert content(spark, path) == sorted([(1, 1, "a"), (None, None, "m"), (2, None, "b"), (3, 1, "y")], key=str)
    with pytest.raises(ValueError, match="lacks"):
        sinks.upsert_partitions(spark.createDataFrame([(1, "x")], "k int, v string"), path, ["k"], ["part"])


def test_many_batches_equal_a_dictionary(spark, tmp_path):
    rng, path, want = random.Random(4), f"{tmp_path}/t", {}
    for n in range(4):
        batch = {k: (k, k % 5, f"{n}.{k}") for k in rng.sample(range(60), 15)}
        put(spark, path, list(batch.values()))
        want |= batch
    assert content(spark, path) == sorted(want.values(), key=str)


def test_counters_are_taken_by_the_run_itself(spark, tmp_path):
    folder, tracker = f"{tmp_path}/log", spark.sparkContext.statusTracker()
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("m"))
    spark.sparkContext.setJobGroup("plain", "")
    rows.write.parquet(f"{tmp_path}/a")
    spark.sparkContext.setJobGroup("rest", "")
    with sinks.logged_run(spark, folder, "count") as run:
        spark.sparkContext.setJobGroup("counted", "")
        run.counting(rows, n=F.count("*"), sevens=F.count_if(F.col("m") == 0)).write.parquet(f"{tmp_path}/b")
        found = run.counters()
        jobs = len(tracker.getJobIdsForGroup("counted"))
        spark.sparkContext.setJobGroup("rest", "")
    assert found == {"n": 1000, "sevens": 143}
    assert jobs == len(tracker.getJobIdsForGroup("plain"))  # no job but the write's own
    r = sinks.run_log(spark, folder).first()
    assert (r["run_type"], r["status"], r["error_msg"], r["counters"]) == ("count", "success", None, {"n": 1000, "sevens": 143})
    assert r["started_at"] <= r["finished_at"]


def test_failed_and_running_runs(spark, tmp_path):
    folder = f"{tmp_path}/log"
    assert sinks.run_log(spark, folder).count() == 0
    with pytest.raises(KeyError), sinks.logged_run(spark, folder, "bad"):
        raise KeyError("x")
    with sinks.logged_run(spark, folder, "good") as run:
        assert {r["run_type"]: r["status"] for r in sinks.run_log(spark, folder).collect()} == {"bad": "failed", "good": "running"}
    rows = {r["run_type"]: r for r in sinks.run_log(spark, folder).collect()}
    assert rows["bad"]["error_msg"] == "KeyError: 'x'" and rows["good"]["status"] == "success" and rows["good"]["run_id"] == run.run_id
    assert [r["run_type"] for r in sinks.recent_runs(sinks.run_log(spark, folder), 1).collect()] == ["good"]
