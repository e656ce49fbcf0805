"""Streams with keyed state: equal to batch results, and blind to what earlier batches wrote."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ingest


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


class Landing:
    """A folder where files land; each call of read() gives the stream of it."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def land(self, rows, files=1):
        self.spark.createDataFrame(rows, self.schema).repartition(files).write.mode("append").parquet(self.path)

    def read(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def test_ingest_once_keeps_the_first_and_reads_no_kept_file(spark, tmp_path):
    landing = Landing(spark, f"{tmp_path}/in", "k string, at timestamp, v int")
    run = lambda: ingest.ingest_once(landing.read(), f"{tmp_path}/w", "k", "at", lambda d: d.withColumn("double", F.col("v") * 2))
    landing.land([(str(i % 10), at(i), i) for i in range(10)] + [(None, at(0), 1), ("late", None, 1)])
    assert sorted((r["k"], r["double"]) for r in run().collect()) == [(str(i), 2 * i) for i in range(10)]
    kept = f"{tmp_path}/w/items"
    os.rename(kept, f"{tmp_path}/away")  # what was written is out of reach for the next batch
    landing.land([(str(i % 10), at(50 + i), 100 + i) for i in range(10)] + [("new", at(60), 7)] * 3)
    assert [(r["k"], r["v"]) for r in run().collect()] == [("new", 7)]
    landing.land([("0", at(70), 5)])
    assert [(r["k"], r["v"]) for r in run().collect()] == [("new", 7)]


def test_ingest_once_drops_what_is_too_late_and_forgets_old_keys(spark, tmp_path):
    landing = Landing(spark, f"{tmp_path}/in", "k string, at timestamp")
    run = lambda: sorted(r["k"] for r in ingest.ingest_once(landing.read(), f"{tmp_path}/w", "k", "at", late="1 hour").collect())
    landing.land([("a", at(0)), ("b", at(600))])
    assert run() == ["a", "b"]
    landing.land([("c", at(10)), ("b", at(590)), ("d", at(601))])
    assert run() == ["a", "b", "d"]


ITEMS = "s string, day date, id string, at timestamp, v double, w double"


def batch(rows, limit):
    groups = {}
    for s, d, i, t, v, w in rows:
        if s is not None and d is not None:
            groups.setdefault((s, d), []).append((t or dt.datetime(1, 1, 1), i, v, w))
    out = {}
    for key, g in groups.items():
        top = sorted(g, key=lambda x: x[:2], reverse=True)[:limit]
        mean = lambda c: (lambda x: sum(x) / len(x) if x else None)([r[c] for r in top if r[c] is not None])
        out[key] = (mean(2), mean(3), len(top), len(g))
    return out


@pytest.mark.parametrize("limit", [1, 5, 32])
def test_refresh_latest_equals_batch(spark, tmp_path, limit):
    rng = random.Random(limit)
    landing = Landing(spark, f"{tmp_path}/in", ITEMS)
    day = dt.date(2024, 1, 1)
    rows = []
    for i in range(400):  # one key holds half of all rows
        s = "hot" if i % 2 else rng.choice(["x", "y", None])
        rows.append((s, rng.choice([day, day, None]), f"{i:03d}", at(rng.randrange(100)) if i % 7 else None, rng.random() if i % 5 else None, None if s == "x" else float(i)))
    done = []
    for part in (rows[:150], rows[150:160], rows[160:]):
        landing.land(part, 2)
        done += part
        out = ingest.refresh_latest(landing.read(), f"{tmp_path}/w", ["s", "day"], ["v", "w"], ["at", "id"], limit)
        got = {(r["s"], r["day"]): (r["v"], r["w"], r["used"], r["total"]) for r in out.collect()}
        want = batch(done, limit)
        assert set(got) == set(want)
        for k, w in want.items():
            assert got[k][2:] == w[2:] and all(a == b or abs(a - b) < 1e-9 for a, b in zip(got[k][:2], w[:2], strict=True))


def test_refresh_latest_writes_only_touched_keys_and_reads_no_item_twice(spark, tmp_path):
    landing = Landing(spark, f"{tmp_path}/in", ITEMS)
    day = dt.date(2024, 1, 1)
    run = lambda: ingest.refresh_latest(landing.read(), f"{tmp_path}/w", ["s", "day"], ["v", "w"], ["at", "id"])
    landing.land([(f"s{i}", day, str(i), at(i), 1.0, 1.0) for i in range(20)])
    assert run().count() == 20
    landing.land([("s3", day, "x", at(100), 3.0, 1.0)])
    assert {r["s"]: r["v"] for r in run().collect()}["s3"] == 2.0
    assert [r["s"] for r in spark.read.parquet(f"{tmp_path}/w/summary/batch=1").collect()] == ["s3"]
    assert os.listdir(f"{tmp_path}/w").count("items") == 0  # items are not kept at all


def test_a_batch_is_dealt_over_all_shuffle_partitions(spark, tmp_path, monkeypatch):
    from tidemark.plans import modelling

    made = []
    monkeypatch.setattr(modelling, "work_folder", lambda *a: made.append(str(tmp_path / str(len(made)))) or made[-1])
    stream = modelling._stream(spark, spark.range(10_000), "dealt", 3)
    seen = []
    stream.writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(seen) == 10_000 and max(seen) < 4_000
    assert len(spark.read.parquet(made[0]).inputFiles()) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
