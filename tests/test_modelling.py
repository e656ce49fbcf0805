"""Feed, model, factor and keyed-stream operators on small tables."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev, feeds, models
from tidemark.streaming import ingest

AT = "2024-05-01 00:00:00"
FEED = """<?xml version="1.0"?><rss><channel><title>c</title>
<item><title> Bank &amp; rates </title><link>http://a/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0530</pubDate><description>d</description></item>
<item><title>Second</title><link>http://a/2</link><updated>2024-01-02T00:00:00Z</updated></item>
<item><title></title><link>http://a/3</link></item><item><title>Third</title><pubDate>soon</pubDate></item></channel></rss>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FEED)
    (tmp_path / "b.xml").write_text("no feed")
    rows = {r["title"]: r for r in feeds.read_feed_items(feeds.landed_documents(spark, str(tmp_path)), "s", F.lit(AT).cast("timestamp")).withColumn("published_at", F.col("published_at").cast("string")).collect()}
    assert {k: r["published_at"] for k, r in rows.items()} == {"Bank & rates": "2024-01-01 04:30:00", "Second": "2024-01-02 00:00:00", "Third": "2024-05-01 00:00:00"}
    assert rows["Second"]["summary"] == "" and rows["Third"]["link"] == ""


def test_sitemap_filter(spark):
    doc = "<urlset>" + "".join(f"<url><loc>http://a/{s}/{i}</loc><lastmod>2024-01-0{i}</lastmod></url>" for s in ("m", "n") for i in (1, 2)) + "</urlset>"
    out = feeds.sitemap_entries(spark.createDataFrame([(doc,), (None,), ("",)], "content string"), "/m/", "2024-01-02")
    assert [tuple(r) for r in out.collect()] == [("http://a/m/2", "2024-01-02")]


def test_articles_take_the_best_title_and_time(spark):
    body = "One is here. " + "Two is a long sentence " * 5 + "ends. Three! Four."
    pages = [("u1", f"<h1>other heading</h1><h1 class='artTitle x'>The <b>best</b> title</h1><meta name='publishdate' content='2024-01-02T00:00:00Z'><div class='artText'>{body}<script>x</script></div>"),
             ("u2", "<h1>long enough title</h1><time datetime='2024-01-03T00:00:00Z'>"), ("u3", "<h1>long enough title</h1>"), ("u4", "<h1>short</h1><time datetime='2024-01-03T00:00:00Z'>"), ("u5", None), (None, "")]
    rows = {r["link"]: r for r in feeds.extract_articles(spark.createDataFrame(pages, "url string, html string"), "s").collect()}
    assert set(rows) == {"u1", "u2"} and rows["u1"]["title"] == "The best title" and rows["u2"]["summary"] == ""
    assert rows["u1"]["summary"].startswith("One is here.") and rows["u1"]["summary"].endswith("Three!")


@pytest.fixture(scope="module")
def line(spark):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), float(i % 7), float(i % 5), 2.0 * (i % 7) - 3.0 * (i % 5) + 1) for i in range(300)]
    return spark.createDataFrame([*rows, (start, None, 1.0, 1.0), (start, 1.0, 1.0, None)], "date date, a double, b double, y double")


def test_linear_model_finds_a_line(line):
    out = models.predict(models.train_regressor(line, ["a", "b"], "y"), line, ["a", "b"])
    assert out.count() == 301 and out.where("abs(pred_ret - y) > 0.05").count() == 0


def test_ablation_ranks_groups(line):
    m = {r["features"]: r["rmse"] for r in models.ablation(line.dropna(), {"one": ["a"], "all": ["a", "b"]}, "y").collect()}
    assert m["all"] < 0.1 < m["one"]


def test_retrain_keeps_versions_and_refuses_few_rows(line, tmp_path):
    log = models.retrain_recent(line, ["a", "b"], "y", str(tmp_path), "v1").first()
    assert (log["status"], log["n_train"], log["n_val"]) == ("fitted", 255, 45) and log["rmse"] < 0.1 and (tmp_path / "v1").exists()
    assert models.retrain_recent(line, ["a", "b"], "y", str(tmp_path), "v2", days=20).first()["status"] == "refused" and not (tmp_path / "v2").exists()


def test_several_factors_equal_planted_ones(spark, line):
    known = line.dropna().select(F.lit("s").alias("symbol"), "a", "b", (F.col("y") + F.when(F.dayofmonth("date") % 2 == 0, 0.1).otherwise(-0.1)).alias("y"))
    rows = {r["factor"]: r for r in ev.factor_regression(known, "y", ["a", "b"], ["symbol"]).collect()}
    assert abs(rows["a"]["beta"] - 2) < 0.02 and abs(rows["b"]["beta"] + 3) < 0.02 and abs(rows["alpha"]["beta"] - 252) < 10
    assert rows["a"]["t"] > 100 and rows["a"]["p"] < 1e-9 and rows["a"]["r2"] > 0.99


def test_deflated_sharpe_of_a_normal_series(spark):
    x = [0.01 * ((i * 37) % 101 - 48) / 101 for i in range(202)]
    got = ev.deflated_sharpe(spark.createDataFrame([("s", v) for v in [*x, None]] + [("few", 0.1), ("flat", 0.0), ("flat", 0.0)], "symbol string, r double"), "r", ["symbol"], 1).collect()
    by = {r["symbol"]: r for r in got}
    s = by["s"]
    spread = (1 - s["skew"] * s["sharpe"] + (s["excess_kurtosis"] + 2) / 4 * s["sharpe"] ** 2) ** 0.5
    assert abs(s["dsr"] - statistics.NormalDist().cdf(s["sharpe"] * 201 ** 0.5 / spread)) < 1e-9 and by["few"]["dsr"] is None and by["flat"]["dsr"] is None


def stream(spark, path, df, parts):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_keeps_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 10), i) for i in range(40)] + [(None, 1)], "k string, at int")
    out = ingest.stream_ingest(stream(spark, f"{tmp_path}/in", rows, 4), f"{tmp_path}/w", "k", "at")
    assert sorted(r["k"] for r in out.collect()) == [str(i) for i in range(10)]


def test_refresh_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 3), i) for i in range(50)], "k string, v int")
    total = lambda d: d.groupBy("k").agg(F.sum("v").alias("s"))
    out = ingest.stream_refresh(stream(spark, f"{tmp_path}/in", rows, 4), f"{tmp_path}/w", ["k"], total)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, total(rows).collect()))


def test_late_correction_wins_in_any_order(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    rows = spark.createDataFrame([("a", day, 1.0, 0), ("a", day, 2.0, 1), ("b", day, 3.0, 0)], "symbol string, date date, close double, revision int")
    out = ingest.late_bars(stream(spark, f"{tmp_path}/in", rows, 3), f"{tmp_path}/w", "revision")
    assert sorted((r["symbol"], r["close"]) for r in out.collect()) == [("a", 2.0), ("b", 3.0)]


def test_labelled_days_are_derived_from_the_table_once(spark):
    """Fits and predictions read the days that were written, not the lines again."""
    from tidemark.plans import modelling

    plan = modelling._labelled(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "parquet" not in plan
