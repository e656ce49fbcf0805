"""Registered queries of the news and evaluation operators, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import evaluation as ev, joins, news, timeseries as ts
from tidemark.plans.queries import query, r, settled
from tidemark.sources import fixtures as fx
from tidemark.streaming import counts

# --- news ---------------------------------------------------------------------------------------------------------


def _entries(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select(
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("url").alias("link"), F.col("html").alias("summary"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("publisher"), (F.timestamp_seconds(F.lit(883645200) + F.col("page_id") * 3600)).alias("published_at"))


@query(r"""WITH e AS (SELECT trim(regexp_extract(html, '<title>([^<]*)', 1)) AS title, trim(url) AS link, trim(regexp_replace(html, '<[^>]+>', '', 'g')) AS summary,
  regexp_extract(url, '^https?://([^/]+)', 1) AS publisher FROM pages)
 SELECT sha1('gnews|' || link) AS article_id, 'gnews_' || substr(regexp_replace(regexp_replace(lower(publisher), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 30) AS source,
  substr(title, 1, 500) AS title, substr(summary, 1, 1500) AS summary, link FROM e WHERE link <> '' AND length(title) >= 8""")
def normalise_feed_entry(spark, sf_dir):
    return news.normalise_entries(_entries(spark, sf_dir)).drop("published_at")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS h FROM pages),
 a AS (SELECT page_id, origin, trim(unnest(h)) AS href, generate_subscripts(h, 1) - 1 AS pos FROM p),
 l AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '//%' THEN 'https:' || href WHEN href LIKE '/%' THEN origin || href
  ELSE origin || '/' || href END AS link FROM a)
 SELECT page_id, link, min(pos) AS pos FROM l WHERE regexp_matches(link, '^https?://') GROUP BY 1, 2""")
def extract_links(spark, sf_dir):
    return news.extract_links(fx.read(spark, sf_dir, "pages"))


def _listed(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


SCORES = fx.ARTICLES + f""", hits AS (SELECT *, string_split_regex(lower(title || ' ' || summary), '[^a-z]+') AS w FROM articles),
 h AS (SELECT * EXCLUDE (w), CAST(len(list_filter(w, lambda x: x IN {_listed(news.POSITIVE)})) AS DOUBLE) AS p, CAST(len(list_filter(w, lambda x: x IN {_listed(news.NEGATIVE)})) AS DOUBLE) AS n FROM hits),
 ex AS (SELECT *, exp(p - greatest(p, n, 1.0)) AS ep, exp(n - greatest(p, n, 1.0)) AS en, exp(1.0 - greatest(p, n, 1.0)) AS eu FROM h),
 scores AS (SELECT article_id, source, published_at, doc_id, ep / (ep + en + eu) AS pos, en / (ep + en + eu) AS neg, eu / (ep + en + eu) AS neu FROM ex)"""


def _item():
    return tx.article_text(F.col("title"), F.col("summary"))


@query(f"WITH {SCORES} SELECT article_id, {r('pos')} AS pos, {r('neg')} AS neg, {r('neu')} AS neu FROM scores")
def score_text(spark, sf_dir):
    s = fx.articles(spark, sf_dir).select("article_id", news.score_text(_item()).alias("s"))
    return s.select("article_id", *[settled(F.col(f"s.{k}")).alias(k) for k in ("pos", "neg", "neu")])


DAILY = SCORES + """, k AS (SELECT *, source AS symbol, CAST(published_at AS DATE) AS trading_date FROM scores WHERE source IS NOT NULL),
 n AS (SELECT *, row_number() OVER (PARTITION BY symbol, trading_date ORDER BY published_at DESC, article_id DESC) AS rn FROM k),
 daily AS (SELECT symbol, trading_date, avg(pos) FILTER (rn <= 32) AS sent_pos, avg(neg) FILTER (rn <= 32) AS sent_neg, avg(neu) FILTER (rn <= 32) AS sent_neu,
  avg(pos) FILTER (rn <= 32) - avg(neg) FILTER (rn <= 32) AS sent_spread, count(*) FILTER (rn <= 32) AS articles_used, count(*) AS news_count FROM n GROUP BY 1, 2)"""
SENT = ("sent_pos", "sent_neg", "sent_neu", "sent_spread")


def _daily(spark, sf_dir):
    """Sources stand for symbols and calendar days for sessions."""
    items = fx.articles(spark, sf_dir).select(F.col("source").alias("symbol"), F.to_date("published_at").alias("trading_date"), "article_id", "published_at", _item().alias("text"))
    return news.sentiment_daily(items)


def _shown(df):
    return df.select("symbol", "trading_date", *[settled(c, 4).alias(c) for c in SENT], "articles_used", "news_count")


@query(f"WITH {DAILY} SELECT symbol, trading_date, " + ", ".join(f"{r(f'round({c}, 6)', 4)} AS {c}" for c in SENT) + ", articles_used, news_count FROM daily")
def sentiment_daily(spark, sf_dir):
    return _shown(_daily(spark, sf_dir))


@query(f"WITH {DAILY}, s AS (SELECT DISTINCT symbol FROM daily), d AS (SELECT DISTINCT trading_date FROM daily) SELECT symbol, trading_date, "
       + ", ".join(f"{r(f'round(coalesce({c}, {0 if c == SENT[3] else 1 / 3}), 6)', 4)} AS {c}" for c in SENT)
       + ", coalesce(articles_used, 0) AS articles_used, coalesce(news_count, 0) AS news_count FROM s CROSS JOIN d LEFT JOIN daily USING (symbol, trading_date)")
def fill_neutral(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    days = daily.agg(F.min("trading_date").alias("a"), F.max("trading_date").alias("b"))
    # A day without any item has no row for any symbol, so the grid is that of the days seen.
    grid = daily.select("symbol").distinct().crossJoin(F.broadcast(days)).select("symbol", F.explode(F.sequence("a", "b")).alias("trading_date"))
    seen = daily.select("trading_date").distinct()
    return _shown(news.fill_neutral(daily, grid.join(seen, "trading_date", "left_semi")))


TITLES = fx.ARTICLES + """, t AS (SELECT lower(title) AS low, min((published_at, article_id)) AS f FROM articles WHERE title <> '' GROUP BY 1),
 g AS (SELECT low, f, list_distinct(list_transform(range(1, greatest(length(low) - 2, 1) + 1), lambda i: substr(low, i, 3))) AS gs FROM t),
 e AS (SELECT low, unnest(gs) AS s FROM g), c AS (SELECT x.low AS x, y.low AS y, count(*) AS k FROM e x JOIN e y ON x.s = y.s AND x.low < y.low GROUP BY 1, 2),
 p AS (SELECT a.f AS fa, b.f AS fb, c.k / (len(a.gs) + len(b.gs) - c.k) AS sim FROM c JOIN g a ON a.low = c.x JOIN g b ON b.low = c.y)"""


@query(f"WITH {TITLES} SELECT struct_extract(CASE WHEN fa < fb THEN fa ELSE fb END, 2) AS a, struct_extract(CASE WHEN fa < fb THEN fb ELSE fa END, 2) AS b, {r('sim')} AS sim FROM p WHERE sim >= 0.75")
def near_dup_pairs(spark, sf_dir):
    return news.near_dup_pairs(news.distinct_titles(fx.articles(spark, sf_dir))).select("a", "b", settled("sim").alias("sim"))


@query()
def near_dedup(spark, sf_dir):
    return news.near_dedup(fx.articles(spark, sf_dir)).select("article_id", "doc_id")


# --- evaluation ---------------------------------------------------------------------------------------------------

PA = fx.PREDICTIONS + ", pa AS (SELECT pr.symbol, pr.date, pred_ret AS p, pr.vol_20d, r.log_return_1d AS y, r.lag_ret_1d AS q FROM predictions pr JOIN ind r USING (symbol, date))"


def _forecasts(spark, sf_dir):
    rets = ts.with_returns(fx.bars(spark, sf_dir)).select("symbol", "date", F.col("log_return_1d").alias("y"), ts.lag_return(1).alias("q"))
    return fx.predictions(spark, sf_dir).select("symbol", "date", F.col("pred_ret").alias("p"), "vol_20d").join(rets, ["symbol", "date"])


@query(f"""WITH {PA}, w AS (SELECT symbol, date, y, count(*) OVER k AS n, avg(p) OVER k AS m FROM pa WINDOW k AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
 SELECT symbol, date, {r('y')} AS label, CAST(n AS INTEGER) AS n, {r('m')} AS mean_p FROM w WHERE n = 30 AND abs(y) <= 0.10""")
def sequence_windows(spark, sf_dir):
    w = ev.sequence_windows(_forecasts(spark, sf_dir), ["p", "q"], "y")
    mean = F.aggregate("window", F.lit(0.0), lambda s, x: s + x[0]) / 30
    return w.select("symbol", "date", settled("label").alias("label"), F.size("window").alias("n"), settled(mean).alias("mean_p"))


SPLIT = fx.RETS + """, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM rets)),
 sp AS (SELECT date, CASE WHEN k <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN k <= floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM d),
 marked AS (SELECT * FROM rets JOIN sp USING (date))"""


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, min(date) AS first, max(date) AS last FROM marked GROUP BY 1")
def chronological_split(spark, sf_dir):
    rows = ev.chronological_split(ts.with_returns(fx.bars(spark, sf_dir)))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(f"""WITH {SPLIT}, q AS (SELECT quantile_cont(close, 0.25) l, quantile_cont(close, 0.5) m, quantile_cont(close, 0.75) h FROM marked WHERE split = 'train')
 SELECT symbol, date, split, {r('(close - m) / CASE WHEN h = l THEN 1.0 ELSE h - l END')} AS close FROM marked, q""")
def robust_scale(spark, sf_dir):
    rows = ev.chronological_split(ts.with_returns(fx.bars(spark, sf_dir))).select("symbol", "date", "split", "close")
    return ev.robust_scale(rows, ["close"], rows.where("split = 'train'")).withColumn("close", settled("close"))


@query(f"""WITH {PA}, m AS (SELECT symbol, avg(abs(y)) + 1e-8 AS s FROM pa GROUP BY 1)
 SELECT symbol, {r('0.6 * avg(CASE WHEN abs(p - y) < 0.005 THEN 0.5 * (p - y) * (p - y) ELSE 0.005 * (abs(p - y) - 0.0025) END) + 0.4 * avg(greatest(-(p / s) * (y / s), 0.0))')} AS loss
 FROM pa JOIN m USING (symbol) GROUP BY 1""")
def directional_huber(spark, sf_dir):
    return _forecasts(spark, sf_dir).groupBy("symbol").agg(settled(ev.directional_huber(F.col("p"), F.col("y"))).alias("loss"))


@query(f"WITH {PA} SELECT symbol, date, {r('0.4 * p + 0.6 * q')} AS p FROM pa")
def blend(spark, sf_dir):
    return _forecasts(spark, sf_dir).select("symbol", "date", settled(ev.blend(F.col("p"), F.col("q"), 0.4)).alias("p"))


@query(f"""WITH {PA}, e AS (SELECT symbol, w / 10.0 AS w, avg(pow(w / 10.0 * p + (1 - w / 10.0) * q - y, 2)) AS mse FROM pa, range(11) t(w) GROUP BY 1, 2)
 SELECT symbol, CAST(arg_min(w, (round(mse, 14), w)) AS DOUBLE) AS weight, {r('sqrt(min(mse))')} AS rmse FROM e GROUP BY 1""")
def tune_blend(spark, sf_dir):
    return ev.tune_blend(_forecasts(spark, sf_dir), "p", "q", "y", ["symbol"]).withColumn("rmse", settled("rmse"))


@query(f"""WITH {fx.BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))
 SELECT CAST((a.i - 180) // 21 + 1 AS INTEGER) AS fold, (SELECT min(date) FROM d) AS train_start, b.date AS train_end, a.date AS test_start, c.date AS test_end, e.date AS warm_start
 FROM d a JOIN d b ON b.i = a.i - 1 JOIN d c ON c.i = a.i + 20 JOIN d e ON e.i = a.i - 30 WHERE a.i >= 180 AND (a.i - 180) % 21 = 0""")
def walk_forward_folds(spark, sf_dir):
    return ev.walk_forward_folds(fx.bars(spark, sf_dir).select("date").distinct())


@query(f"""WITH {PA}, f AS (SELECT DISTINCT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM pa)), g AS (SELECT max(i) + 1 AS n FROM f),
 tested AS (SELECT CAST((i - 180) // 21 + 1 AS INTEGER) AS fold, p, y FROM pa JOIN f USING (date), g WHERE i >= 180 AND (i - 180) // 21 < (n - 180) // 21)
 SELECT fold, count(*) AS n, {r('avg(CAST(sign(p) = sign(y) AS DOUBLE))')} AS hit_rate, {r('sqrt(avg((p - y) * (p - y)))')} AS rmse FROM tested GROUP BY 1 HAVING count(*) >= 10""")
def walk_forward(spark, sf_dir):
    rows = _forecasts(spark, sf_dir)
    folds = ev.walk_forward_folds(rows.select("date").distinct())
    days = folds.select("fold", F.explode(F.sequence("test_start", "test_end")).alias("date"))
    m = rows.join(F.broadcast(days), "date").groupBy("fold").agg(  # one row a day
        F.count("*").alias("n"), settled(F.avg((F.signum("p") == F.signum("y")).cast("double"))).alias("hit_rate"), settled(F.sqrt(F.avg(F.pow(F.col("p") - F.col("y"), 2)))).alias("rmse"))
    return m.where("n >= 10")


@query(f"""WITH {fx.RETS}, v AS (SELECT symbol, date, log_return_1d AS ret, exp(sum(log_return_1d) OVER (PARTITION BY symbol ORDER BY date)) AS v FROM rets),
 c AS (SELECT *, v / max(v) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd FROM v)
 SELECT symbol AS series, {r('(exp(sum(ret)) - 1) * 100', 4)} AS total_return, {r('avg(ret) * 25200', 4)} AS ann_return, {r('stddev_samp(ret) * sqrt(252.0) * 100', 4)} AS ann_vol,
 {r('avg(ret) * 252 / (stddev_samp(ret) * sqrt(252.0))', 4)} AS sharpe, {r('min(dd) * 100', 4)} AS max_dd, count(*) AS n_days FROM c GROUP BY 1 HAVING count(*) >= 5""")
def performance_table(spark, sf_dir):
    t = ev.performance_table(ts.with_returns(fx.bars(spark, sf_dir)).select(F.col("symbol").alias("series"), "date", F.col("log_return_1d").alias("ret")))
    return t.select("series", *[settled(c, 4).alias(c) for c in ("total_return", "ann_return", "ann_vol", "sharpe", "max_dd")], "n_days")


@query(f"""WITH {fx.RETS}, m AS (SELECT date, avg(log_return_1d) AS x FROM rets GROUP BY 1), j AS (SELECT symbol, log_return_1d AS y, x FROM rets JOIN m USING (date))
 SELECT symbol, regr_count(y, x) AS n, {r('regr_slope(y, x)')} AS beta, {r('regr_intercept(y, x) * 252')} AS alpha, {r('regr_r2(y, x)')} AS r2,
 {r('regr_slope(y, x) / sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / (regr_count(y, x) - 2) / regr_sxx(y, x))', 4)} AS t FROM j GROUP BY 1 HAVING regr_count(y, x) >= 20""")
def factor_attribution(spark, sf_dir):
    rets = ts.with_returns(fx.bars(spark, sf_dir)).select("symbol", "date", F.col("log_return_1d").alias("y"))
    rows = rets.join(rets.groupBy("date").agg(F.avg("y").alias("x")), "date")
    t = ev.single_factor(rows, "y", "x", ["symbol"])
    return t.select("symbol", "n", *[settled(c).alias(c) for c in ("beta", "alpha", "r2")], settled("t", 4).alias("t"))


@query(f"""WITH {PA}, e AS (SELECT symbol, date, (p - y) * (p - y) - (q - y) * (q - y) AS d FROM pa), l AS (SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY date) AS d1 FROM e)
 SELECT symbol, count(*) AS n, {r('avg(d) / sqrt(greatest(var_samp(d) + covar_samp(d, d1), 1e-12) / count(*)) * sqrt((count(*) + 1 - 4 + 2.0 / count(*)) / count(*))', 4)} AS dm FROM l GROUP BY 1""")
def diebold_mariano(spark, sf_dir):
    e = _forecasts(spark, sf_dir).select("symbol", "date", (F.col("p") - F.col("y")).alias("a"), (F.col("q") - F.col("y")).alias("b"))
    return ev.diebold_mariano(e, "a", "b", "symbol", "date", h=2).select("symbol", "n", settled("dm", 4).alias("dm"))


@query(f"""WITH {PA}, h AS (SELECT symbol, avg(CAST(sign(p) = sign(y) AS DOUBLE)) AS a, avg(CAST(sign(q) = sign(y) AS DOUBLE)) AS b FROM pa GROUP BY 1)
 SELECT {r('avg(a)')} AS mean_a, {r('avg(b)')} AS mean_b, {r('avg(a - b)')} AS mean_diff, {r('avg(a - b) / (stddev_samp(a - b) / sqrt(count(*)))', 4)} AS t_stat FROM h""")
def paired_t(spark, sf_dir):
    right = lambda c: F.avg((F.signum(c) == F.signum("y")).cast("double"))
    t = ev.paired_t(_forecasts(spark, sf_dir).groupBy("symbol").agg(right("p").alias("a"), right("q").alias("b")), "a", "b")
    return t.select(*[settled(c).alias(c) for c in ("mean_a", "mean_b", "mean_diff")], settled("t_stat", 4).alias("t_stat"))


@query()
def bootstrap_ci(spark, sf_dir):
    daily = ts.with_returns(fx.bars(spark, sf_dir)).groupBy("date").agg(F.avg("log_return_1d").alias("ret"))
    return ev.bootstrap_ci(daily, "ret", ["date"], F.avg)


@query(f"""WITH {PA}, s AS (SELECT avg(y) AS daily_return FROM pa GROUP BY date),
 c AS (SELECT 'rolling_sharpe' AS metric, avg(daily_return) / stddev_samp(daily_return) * sqrt(252.0) AS value, 0.5 AS threshold, count(*) AS n, false AS up FROM s
  UNION ALL SELECT 'hit_rate', avg(CAST(p * y > 0 AS DOUBLE)), 0.48, count(*), false FROM pa UNION ALL SELECT 'information_coefficient', corr(p, y), 0.02, count(*), false FROM pa
  UNION ALL SELECT 'prediction_bias', avg(CAST(sign(p) <> sign(y) AS DOUBLE)), 0.55, count(*), true FROM pa)
 SELECT metric, {r('value', 4)} AS value, CAST(threshold AS DOUBLE) AS threshold, n, CASE WHEN n < 5 THEN 'insufficient_data' WHEN up AND value > threshold THEN 'alert' WHEN NOT up AND value < threshold THEN 'alert' ELSE 'ok' END AS status FROM c""")
def health_report(spark, sf_dir):
    rows = _forecasts(spark, sf_dir)
    snapshots = rows.groupBy("date").agg(F.avg("y").alias("daily_return"))
    trades = rows.select((F.col("p") * F.col("y")).alias("pnl_net"), F.col("p").alias("pred_ret"), F.col("y").alias("actual_ret"))
    out = ev.health_report(snapshots, trades, rows.select("date", F.col("p").alias("sent_spread"))).where("metric != 'sentiment_drift'")
    return out.withColumn("value", settled("value", 4))


@query(f"""WITH {PA}, k AS (SELECT p AS x, CAST(row_number() OVER (ORDER BY date, p) > count(*) OVER () // 2 AS INTEGER) AS side FROM pa), r AS (SELECT min(x) lo, max(x) hi FROM k),
 c AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS q FROM k, r GROUP BY 1),
 g AS (SELECT coalesce(p, 0) + 1e-9 AS p, coalesce(q, 0) + 1e-9 AS q FROM range(20) t(b) LEFT JOIN c ON c.bin = b), t AS (SELECT sum(p) sp, sum(q) sq FROM g),
 v AS (SELECT sum(p / sp * ln((p / sp) / (q / sq))) AS kl FROM g, t)
 SELECT 'sentiment_drift' AS metric, {r('kl', 4)} AS value, CASE WHEN kl > 0.15 THEN 'alert' ELSE 'ok' END AS status FROM v""")
def drift_check(spark, sf_dir):
    out = ev.drift_check(_forecasts(spark, sf_dir).select("date", F.col("p").alias("sent_spread")))
    return out.select("metric", settled("value", 4).alias("value"), "status")


# --- streaming ----------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS at, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_counts(spark, sf_dir):
    schema = fx.read(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))  # a pattern may name a file, too
    out = counts.stream_counts(files, counts.work_folder(spark, "stream_counts"))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))
