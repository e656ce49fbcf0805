"""Registered queries of the feed, model, factor and keyed-stream operators, with their SQL oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import evaluation as ev, feeds, models, news, portfolio, timeseries as ts
from tidemark.operators.lineage import checkpointed
from tidemark.plans.queries import SIGNALS, _TOP, _TRADES, _trades, query, r, settled
from tidemark.plans.research import DAILY, SENT, _item, _shown, health_report
from tidemark.sources import fixtures as fx
from tidemark.streaming import ingest
from tidemark.streaming.counts import work_folder

# --- feeds --------------------------------------------------------------------------------------------------------


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(name, c):
    return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))


def _documents(pages, element, columns, around):
    """content: XML documents of up to 50 pages each, their columns as elements."""
    one = _element(element, F.concat(*[F.coalesce(_element(k, _escaped(c)), F.lit("")) for k, c in columns.items()]))
    return pages.groupBy((F.col("page_id") / 50).cast("long").alias("block")).agg(F.array_join(F.collect_list(one), "").alias("all")).select(
        F.concat(F.lit("".join(f"<{t}>" for t in around)), "all", F.lit("".join(f"</{t}>" for t in reversed(around)))).alias("content"))


def _page_time():
    return F.timestamp_seconds(F.lit(883645200) + F.col("page_id") * 3600)


PAGE_TIME = "TIMESTAMP '1998-01-01 09:00:00' + to_hours(CAST(page_id AS INTEGER))"


@query(f"""SELECT sha1('pages|' || trim(url)) AS article_id, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS title, url AS link,
 CASE WHEN page_id % 3 = 2 THEN TIMESTAMP '1999-01-01 00:00:00' ELSE {PAGE_TIME} END AS published_at FROM pages WHERE trim(regexp_extract(html, '<title>([^<]*)', 1)) <> ''""")
def read_feed_items(spark, sf_dir):
    """Two of three items carry a time, in either of its places; the others get the time of fetching."""
    p = fx.read(spark, sf_dir, "pages")
    docs = _documents(p, "item", {"title": F.regexp_extract("html", "<title>([^<]*)", 1), "link": F.col("url"), "pubDate": F.when(F.col("page_id") % 3 == 0, F.date_format(_page_time(), "EEE, dd MMM yyyy HH:mm:ss Z")),
                               "updated": F.when(F.col("page_id") % 3 == 1, F.date_format(_page_time(), "yyyy-MM-dd'T'HH:mm:ssXXX"))}, ("rss", "channel"))
    out = feeds.read_feed_items(docs, "pages", F.lit("1999-01-01 00:00:00").cast("timestamp"))
    return out.select("article_id", "title", "link", F.col("published_at").cast("timestamp_ntz"))


@query(f"SELECT url AS loc, strftime({PAGE_TIME}, '%Y-%m-%d') AS lastmod FROM pages WHERE contains(url, '/en/') AND contains(strftime({PAGE_TIME}, '%Y-%m-%d'), '1998-01')")
def sitemap_entries(spark, sf_dir):
    docs = _documents(fx.read(spark, sf_dir, "pages"), "url", {"loc": F.col("url"), "lastmod": F.date_format(_page_time(), "yyyy-MM-dd")}, ("urlset",))
    return feeds.sitemap_entries(docs, "/en/", "1998-01")


@query(rf"""WITH t AS (SELECT url, page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages)
 SELECT sha1('pages|' || url) AS article_id, substr(title, 1, 500) AS title, url AS link, {PAGE_TIME} AS published_at FROM t WHERE length(title) >= 10""")
def extract_articles(spark, sf_dir):
    out = feeds.extract_articles(fx.read(spark, sf_dir, "pages"), "pages", _page_time())
    return out.select("article_id", "title", "link", F.col("published_at").cast("timestamp_ntz"))


# --- models -------------------------------------------------------------------------------------------------------

GROUPS = {"returns": ["lag_ret_1d", "lag_ret_2d"], "band": ["bb_position", "price_to_ma20"], "volume": ["rel_volume", "vol_20d"],
          "all": ["lag_ret_1d", "lag_ret_2d", "bb_position", "price_to_ma20", "rel_volume", "vol_20d"]}


def _labelled(spark, sf_dir):
    """Indicators of a day with the return of the symbol's next bar, written once: splits, fits and predictions read these rows again and again."""
    rets = ts.with_returns(fx.bars(spark, sf_dir))
    return checkpointed(rets.select("symbol", "date", ts.lag_return(1).alias("lag_ret_1d"), ts.lag_return(2).alias("lag_ret_2d"), ts.bollinger_position().alias("bb_position"), ts.price_to_ma().alias("price_to_ma20"),
                       ts.relative_volume().alias("rel_volume"), ts.realised_vol().alias("vol_20d"), F.lead("log_return_1d").over(Window.partitionBy("symbol").orderBy("date")).alias("target")))


@query()
def predict(spark, sf_dir):
    rows = ev.chronological_split(_labelled(spark, sf_dir))
    model = models.train_regressor(rows.where("split = 'train'"), GROUPS["all"], "target", "trees")
    return models.predict(model, rows.where("split = 'test'"), GROUPS["all"]).select("symbol", "date", "pred_ret")


@query()
def ablation(spark, sf_dir):
    return models.ablation(_labelled(spark, sf_dir), GROUPS, "target")


@query()
def retrain_recent(spark, sf_dir):
    return models.retrain_recent(_labelled(spark, sf_dir), GROUPS["all"], "target", work_folder(spark, "models"), "v1")


# --- factors ------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.RETS}, m AS (SELECT symbol, stddev_samp(log_return_1d) AS s, avg(log_return_1d) AS a, skewness(log_return_1d) AS g, count(*) AS n FROM rets GROUP BY 1)
 SELECT symbol, n, {r('a / s * sqrt(252.0)', 4)} AS sharpe, {r('g', 4)} AS skew FROM m""")
def sharpe_inputs(spark, sf_dir):
    out = ev.deflated_sharpe(ts.with_returns(fx.bars(spark, sf_dir)), "log_return_1d", ["symbol"], trials=4)
    return out.select("symbol", "n", settled("sharpe", 4).alias("sharpe"), settled("skew", 4).alias("skew"))


@query()
def deflated_sharpe(spark, sf_dir):
    return ev.deflated_sharpe(ts.with_returns(fx.bars(spark, sf_dir)), "log_return_1d", ["symbol"], trials=4)


@query(f"""WITH {SIGNALS}{_TOP}{_TRADES} SELECT date, {r("sum(position_size * ((CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END) * actual_ret - 0.002))", 4)} AS daily_ret
 FROM trades WHERE status = 'closed' GROUP BY 1""")
def strategy_daily_return(spark, sf_dir):
    out = ev.strategy_daily_return(portfolio.trade_pnl(_trades(spark, sf_dir)), 1e6)
    return out.select("date", settled("daily_ret", 4).alias("daily_ret"))


def _factors(spark, sf_dir):
    """Returns by symbol with the market's, momentum's and value's return of the day."""
    rets = checkpointed(ts.with_returns(fx.bars(spark, sf_dir)))
    legs = {"momentum": ts.momentum(), "value": -ts.high_ratio()}
    rows = rets.select("symbol", "date", F.col("log_return_1d").alias("ret")).join(rets.groupBy("date").agg(F.avg("log_return_1d").alias("market")), "date")
    for name, score in legs.items():
        scored = rets.select("symbol", "date", F.col("log_return_1d").alias("y"), F.round(score, 7).alias("score"))
        rows = rows.join(ev.leg_returns(portfolio.rank_legs(scored), "y").withColumnRenamed("ret", name), "date")
    return rows


@query()
def factor_regression(spark, sf_dir):
    return ev.factor_regression(_factors(spark, sf_dir), "ret", ["market", "momentum", "value"], ["symbol"])


@query()
def comparison_report(spark, sf_dir):
    rows = _factors(spark, sf_dir)
    betas = ev.factor_regression(rows, "ret", ["market", "momentum", "value"], ["symbol"]).withColumnRenamed("symbol", "series")
    return ev.comparison_report(rows.select(F.col("symbol").alias("series"), "date", "ret"), betas)


@query()
def health_history(spark, sf_dir):
    return ev.health_history(health_report(spark, sf_dir), "2001-12-31")


# --- keyed streams ------------------------------------------------------------------------------------------------


def _stream(spark, df, name, parts):
    """df as files of a folder, read as a stream of so many batches. A batch has as many files as make one for each shuffle partition in all, so that no
    task writes or reads a whole batch."""
    path, each = work_folder(spark, name), math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / parts)
    df.repartition(parts * each).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


@query(f"WITH {fx.ARTICLES} SELECT article_id, source, CAST(published_at AS DATE) AS trading_date FROM articles")
def stream_ingest(spark, sf_dir):
    """Every article lands twice and is kept once."""
    a = fx.articles(spark, sf_dir).select("article_id", "source", "published_at")
    out = ingest.ingest_once(_stream(spark, a.union(a), "landed", 4), work_folder(spark, "ingest"), "article_id", "published_at", lambda d: d.withColumn("trading_date", F.to_date("published_at")), late="200 days")
    return out.drop("published_at")


@query(f"WITH {DAILY} SELECT symbol, trading_date, " + ", ".join(f"{r(f'round({c}, 6)', 4)} AS {c}" for c in SENT) + ", articles_used, news_count FROM daily")
def stream_refresh(spark, sf_dir):
    a = fx.articles(spark, sf_dir).where("source is not null").select(F.col("source").alias("symbol"), F.to_date("published_at").alias("trading_date"), "article_id", "published_at", _item().alias("text"))
    scored = _stream(spark, a, "landed", 3).withColumn("s", news.score_text(F.col("text"))).select("*", *[F.col(f"s.{k}").alias(f"sent_{k}") for k in ("pos", "neg", "neu")])
    out = ingest.refresh_latest(scored, work_folder(spark, "refresh"), ["symbol", "trading_date"], ["sent_pos", "sent_neg", "sent_neu"], ["published_at", "article_id"])
    named = out.withColumns({"sent_spread": F.round(F.col("sent_pos") - F.col("sent_neg"), 6), **{c: F.round(c, 6) for c in SENT[:3]}})
    return _shown(named.withColumnsRenamed({"used": "articles_used", "total": "news_count"}))


@query(f"WITH {fx.BARS}, e AS (SELECT max(date) AS d FROM bars) SELECT symbol, date, {r('CASE WHEN date > d - 5 THEN close + 1 ELSE close END')} AS close FROM bars, e")
def late_bars(spark, sf_dir):
    """The last five days land again with a corrected close."""
    b = fx.bars(spark, sf_dir).select("symbol", "date", "close")
    again = b.crossJoin(F.broadcast(b.agg(F.max("date").alias("d")))).where(F.col("date") > F.date_sub("d", 5)).select("symbol", "date", (F.col("close") + 1).alias("close"), F.lit(1).alias("revision"))
    landed = b.withColumn("revision", F.lit(0)).unionByName(again)
    out = ingest.late_bars(_stream(spark, landed, "landed", 3), work_folder(spark, "bars"), "revision")
    return out.select("symbol", "date", settled("close").alias("close"))
