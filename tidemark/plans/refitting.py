"""Registered queries of refitted models, positions over time, text scorers and large dictionaries, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import evaluation as ev, feeds, joins, models, news, portfolio, scoring, sinks, timeseries as ts, walkforward
from tidemark.operators.lineage import bounded_broadcast
from tidemark.plans.modelling import GROUPS, _labelled, _page_time
from tidemark.plans.queries import SIGNALS, SQL, TAGS, _NEW, _OLD, _TOP, _old_new, _signals, query, r, settled
from tidemark.plans.research import PA, _entries, _forecasts, _item, health_report
from tidemark.sources import fixtures as fx
from tidemark.streaming.counts import work_folder

# --- walk-forward -------------------------------------------------------------------------------------------------

MODELS, BLEND = {"one": ["p"], "two": ["p", "q"]}, {"one": 0.4, "two": 0.6}
REFITS = PA + """, f AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM pa)),
 folds AS (SELECT CAST((i - 180) // 21 + 1 AS INTEGER) AS fold, i AS start FROM f WHERE i >= 180 AND (i - 180) % 21 = 0 AND i + 21 <= n), rows AS (SELECT p, q, y, i FROM pa JOIN f USING (date)),
 m AS (SELECT fold, start, count(*) AS n_train, avg(p) AS mp, avg(q) AS mq, avg(y) AS my, var_pop(p) AS pp, var_pop(q) AS qq, covar_pop(p, q) AS pq, covar_pop(p, y) AS py, covar_pop(q, y) AS qy
  FROM folds JOIN rows ON i < start GROUP BY 1, 2),
 c AS (SELECT *, py / pp AS b, (py * qq - qy * pq) / (pp * qq - pq * pq) AS bp, (qy * pp - py * pq) / (pp * qq - pq * pq) AS bq FROM m),
 s AS (SELECT fold, n_train, y, my + b * (p - mp) AS one, my + bp * (p - mp) + bq * (q - mq) AS two FROM c JOIN rows ON i BETWEEN start AND start + 20),
 e AS (SELECT *, 0.4 * one + 0.6 * two AS ens FROM s)"""
_SCORED = "".join(f", {r(f'sqrt(avg(({k} - y) * ({k} - y)))')} AS rmse_{k}, {r(f'avg(abs({k} - y))')} AS mae_{k}, {r(f'avg(CAST(sign({k}) = sign(y) AS DOUBLE))')} AS hit_rate_{k}, {r(f'corr({k}, y)', 4)} AS ic_{k}"
                  for k in ("one", "two", "ens"))


def _refitted(spark, sf_dir):
    return walkforward.walk_forward(_forecasts(spark, sf_dir), MODELS, "y", BLEND)


@query(f"WITH {REFITS} SELECT fold, n_train, count(*) AS n_test{_SCORED} FROM e GROUP BY 1, 2 HAVING count(*) >= 10")
def walk_forward_refit(spark, sf_dir):
    """Two linear models and their blend, fitted anew for every fold on all rows before it."""
    out = _refitted(spark, sf_dir).drop("train_end", "test_start", "test_end")
    return out.select(*[settled(c, 4 if c.startswith("ic") else 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"""WITH {REFITS}, g AS (SELECT fold, sqrt(avg((one - y) * (one - y))) AS rmse_one, sqrt(avg((ens - y) * (ens - y))) AS rmse_ens, corr(two, y) AS ic_two FROM e GROUP BY 1 HAVING count(*) >= 10)
 SELECT 'rmse' AS metric, 'one' AS model, {r('avg(rmse_one)')} AS mean, count(rmse_one) AS folds FROM g UNION ALL SELECT 'rmse', 'ens', {r('avg(rmse_ens)')}, count(rmse_ens) FROM g
 UNION ALL SELECT 'ic', 'two', {r('avg(ic_two)', 4)}, count(ic_two) FROM g""")
def walk_forward_means(spark, sf_dir):
    means = walkforward.fold_means(_refitted(spark, sf_dir)).where("metric = 'rmse' and model != 'two' or metric = 'ic' and model = 'two'")
    return means.withColumn("mean", F.when(F.col("metric") == "ic", settled("mean", 4)).otherwise(settled("mean")))


# --- positions over time ------------------------------------------------------------------------------------------

MONTHLY = SIGNALS + _TOP + """, firsts AS (SELECT min(date) AS date FROM top GROUP BY date_trunc('month', date)), chosen AS (SELECT * FROM top SEMI JOIN firsts USING (date)),
 steps AS (SELECT symbol, date, close AS entry_price, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS exit_date, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS exit_price
  FROM bars SEMI JOIN firsts USING (date)),
 trades AS (SELECT t.symbol, t.date, t.signal, t.position_size, entry_price, exit_date, round(ln(exit_price / entry_price), 8) AS actual_ret FROM chosen t JOIN steps USING (symbol, date) WHERE signal <> 'FLAT'),
 days AS (SELECT DISTINCT date FROM bars),
 held AS (SELECT d.date, t.symbol, t.signal, t.position_size, t.entry_price, b.close FROM trades t JOIN days d ON d.date >= t.date AND (t.exit_date IS NULL OR d.date < t.exit_date)
  LEFT JOIN bars b ON b.symbol = t.symbol AND b.date = d.date)"""
_GAIN = "1e6 * position_size * CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END * ln(coalesce(close, entry_price) / entry_price)"


def _monthly(spark, sf_dir):
    """Signals of each month's first date, held to the next one."""
    top = portfolio.top_signals(_signals(spark, sf_dir))
    firsts = top.groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("date")).select("date")
    bars = fx.bars(spark, sf_dir)
    return portfolio.round_trip_trades(top.join(F.broadcast(firsts), "date", "left_semi"), bars), bars


@query(f"WITH {MONTHLY} SELECT date, count(*) AS positions, {r(f'sum(1e6 * position_size + {_GAIN})', 0)} AS value FROM held GROUP BY 1")
def open_positions_value(spark, sf_dir):
    trades, bars = _monthly(spark, sf_dir)
    held = portfolio.open_positions(trades.withColumn("capital_allocated", 1e6 * F.col("position_size")), bars.select("date"))
    value = portfolio.mark_to_market(held, bars).select("date", settled("value", 0).alias("value"))
    return held.groupBy("date").agg(F.count("*").alias("positions")).join(value, "date")


@query(f"""WITH {MONTHLY}, u AS (SELECT date, sum({_GAIN}) AS unrealised, count(*) AS open_positions, count(*) FILTER (signal = 'LONG') AS longs, count(*) FILTER (signal = 'SHORT') AS shorts FROM held GROUP BY 1),
 c AS (SELECT exit_date AS date, sum(round(round(1e6 * position_size * (CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END) * actual_ret, 4) - round(1e6 * position_size * 0.002, 4), 4)) AS won FROM trades WHERE exit_date IS NOT NULL GROUP BY 1),
 v AS (SELECT d.date, sum(coalesce(won, 0)) OVER (ORDER BY d.date) AS realised, coalesce(unrealised, 0) AS unrealised, coalesce(open_positions, 0) AS open_positions, coalesce(longs, 0) AS longs, coalesce(shorts, 0) AS shorts
  FROM days d LEFT JOIN c ON c.date = d.date LEFT JOIN u ON u.date = d.date)
 SELECT date, {r('round(1e6 + realised + unrealised, 2)', 0)} AS portfolio_value, {r('(1e6 + realised + unrealised) / 1e6 - 1', 4)} AS cum_return, open_positions, longs, shorts FROM v""")
def daily_valuation(spark, sf_dir):
    trades, bars = _monthly(spark, sf_dir)
    out = portfolio.daily_valuation(trades, bars, bars.select("date"))
    return out.select("date", settled("portfolio_value", 0).alias("portfolio_value"), settled("cum_return", 4).alias("cum_return"), "open_positions", "longs", "shorts")


# --- text scorers -------------------------------------------------------------------------------------------------


def _rated(spark, sf_dir):
    """Articles with a label of their tone: neg if toxic, pos if of quality, else neu; null where labels lack it."""
    said = fx.read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "neg").when(F.col("quality") == 1, "pos").otherwise("neu").alias("tone"))
    return fx.articles(spark, sf_dir).select("article_id", "source", "published_at", "doc_id", _item().alias("text")).join(bounded_broadcast(said), "doc_id", "left")


LEXICON = fx.ARTICLES + r""", rated AS (SELECT article_id, title || ' ' || summary AS text, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN toxic = 1 THEN 'neg' WHEN quality = 1 THEN 'pos' ELSE 'neu' END END AS tone
  FROM articles a LEFT JOIN labels l ON l.doc_id = a.doc_id),
 split AS (SELECT article_id, tone, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM rated), k AS (SELECT tone, unnest(list_distinct(ws)) AS word FROM split WHERE tone IS NOT NULL),
 cn AS (SELECT count(*) AS n, count(*) FILTER (tone = 'pos') AS np, count(*) FILTER (tone = 'neg') AS nn FROM split WHERE tone IS NOT NULL),
 d AS (SELECT word, count(*) AS df, count(*) FILTER (tone = 'pos') AS p, count(*) FILTER (tone = 'neg') AS m FROM k GROUP BY 1 HAVING count(*) >= 5),
 lex AS (SELECT word, greatest(ln((p + 0.5) / (np + 1)) - ln((df - p + 0.5) / (n - np + 1)), 0.0) AS pos, greatest(ln((m + 0.5) / (nn + 1)) - ln((df - m + 0.5) / (n - nn + 1)), 0.0) AS neg FROM d, cn)"""


@query(f"WITH {LEXICON} SELECT word, {r('pos')} AS pos, {r('neg')} AS neg FROM lex")
def learn_lexicon(spark, sf_dir):
    return scoring.learn_lexicon(_rated(spark, sf_dir), "text", "tone").select("word", *[settled(c).alias(c) for c in ("pos", "neg")])


@query(f"""WITH {LEXICON}, u AS (SELECT article_id, unnest(ws) AS word FROM split), h AS (SELECT article_id, sum(pos) AS p, sum(neg) AS m FROM u JOIN lex USING (word) GROUP BY 1),
 w AS (SELECT s.article_id, 10 * coalesce(p, 0) / greatest(len(ws), 1) AS p, 10 * coalesce(m, 0) / greatest(len(ws), 1) AS m FROM split s LEFT JOIN h USING (article_id)),
 e AS (SELECT article_id, exp(p) AS p, exp(m) AS m, exp(1.0) AS u FROM w)
 SELECT article_id, {r('p / (p + m + u)')} AS pos, {r('m / (p + m + u)')} AS neg, {r('u / (p + m + u)')} AS neu FROM e""")
def lexicon_scores(spark, sf_dir):
    """Every article by a lexicon that the labelled ones teach."""
    a = _rated(spark, sf_dir)
    out = scoring.lexicon_scores(a, scoring.learn_lexicon(a, "text", "tone"), "article_id", "text")
    return out.select("article_id", *[settled(c).alias(c) for c in scoring.SCORES])


@query()
def model_scores(spark, sf_dir):
    """Daily means by source, scored by a model fitted on the labelled articles."""
    model = spark.sparkContext.broadcast(scoring.fit_text_model(_rated(spark, sf_dir), "text", "tone"))
    items = fx.articles(spark, sf_dir).withColumn("text", _item()).select(F.col("source").alias("symbol"), F.to_date("published_at").alias("trading_date"), "article_id", "published_at", "text")
    return news.sentiment_daily(items, scorer=scoring.model_scorer(model))


# --- models on windows --------------------------------------------------------------------------------------------


def _windows(spark, sf_dir, pool, labelled=True):
    return models.windowed(_labelled(spark, sf_dir), GROUPS["all"], "target", 30, pool, labelled)


@query()
def predict_windows(spark, sf_dir):
    rows = ev.chronological_split(_windows(spark, sf_dir, "flat"))
    model = models.train_regressor(rows.where("split = 'train'"), "x", "target")
    return models.predict(model, rows.where("split = 'test'"), "x").select("symbol", "date", "pred_ret")


@query()
def ablation_windows(spark, sf_dir):
    """Pooled windows against windows of all lags."""
    pooled = _windows(spark, sf_dir, "pooled").withColumnRenamed("x", "pooled")
    both = pooled.join(_windows(spark, sf_dir, "flat").select("symbol", "date", F.col("x").alias("flat")), ["symbol", "date"])
    return models.ablation(both, {"pooled": "pooled", "flat": "flat"}, "target")


# --- large dictionaries -------------------------------------------------------------------------------------------


@query(f"WITH {TAGS} SELECT article_id, symbol, match_keyword FROM tags")
def tag_dictionary(spark, sf_dir):
    """The aliases of tag_symbols, joined as a table."""
    aliases = spark.createDataFrame(fx.ALIASES, "alias string, symbol string")
    return joins.tag_dictionary(fx.articles(spark, sf_dir), aliases, tx.article_text(F.col("title"), F.col("summary")))


@query()
def tag_titles(spark, sf_dir):
    """A dictionary that grows with the table: the first two words of every title, for its source."""
    a = fx.articles(spark, sf_dir)
    aliases = a.select(F.regexp_extract(F.lower("title"), "^([a-z0-9_]+ [a-z0-9_]+)", 1).alias("alias"), F.col("source").alias("symbol")).where("alias != ''").distinct()
    return joins.tag_dictionary(a, aliases, tx.article_text(F.col("title"), F.col("summary")))


# --- writes -------------------------------------------------------------------------------------------------------


@query(f"SELECT *, CAST(k % 16 AS INTEGER) AS part FROM (SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_OLD} WHERE k NOT IN (SELECT k FROM {_NEW}))")
def upsert_partitions(spark, sf_dir):
    """The tables of upsert, written to a table of sixteen partitions one after the other."""
    path = work_folder(spark, "orders")
    for rows in _old_new(spark, sf_dir):
        sinks.upsert_partitions(rows.withColumn("part", (F.col("k") % 16).cast("int")), path, ["k"], ["part"])
    return spark.read.parquet(path)


@query(f"SELECT 'insert' AS run_type, 'success' AS status, 'rows' AS counter, count(*) AS n FROM {_NEW} UNION ALL SELECT 'insert', 'success', 'large', count(*) FROM {_NEW} WHERE v > 100000")
def run_counters(spark, sf_dir):
    """Counters that a run takes while it writes."""
    folder = work_folder(spark, "runs")
    with sinks.logged_run(spark, folder, "insert") as run:
        run.counting(_old_new(spark, sf_dir)[1], rows=F.count("*"), large=F.count_if(F.col("v") > 100000)).write.parquet(f"{folder}/out")
    return sinks.run_log(spark, folder).select("run_type", "status", F.explode("counters").alias("counter", "n"))


@query("SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS started_at, o_totalprice AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_runs(spark, sf_dir):
    """Orders stand for runs."""
    runs = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("started_at"), F.col("o_totalprice").alias("total"))
    return sinks.recent_runs(runs)


@query(r"""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[' || chr(8203) || chr(8204) || chr(8205) || chr(65279) || ']', '', 'g'), '\s+', ' ', 'g')), 1, 500) AS clean FROM documents""")
def clean_text(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query(r"""SELECT doc_id, array_to_string(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:3], ' ') AS lead FROM documents""")
def first_sentences(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", tx.first_sentences(F.col("text")).alias("lead"))


# --- feeds and reports --------------------------------------------------------------------------------------------


@query("SELECT n.article_id, n.source, n.title, n.link FROM (" + SQL["normalise_feed_entry"] + """) n JOIN pages p ON trim(p.url) = n.link
 WHERE CAST(TIMESTAMP '1998-01-01 09:00:00' + to_hours(CAST(page_id AS INTEGER)) AS DATE) BETWEEN DATE '1998-01-02' AND DATE '1998-01-03'""")
def feed_window(spark, sf_dir):
    """Entries of two publication days."""
    return news.normalise_entries(_entries(spark, sf_dir), ("1998-01-02", "1998-01-03")).select("article_id", "source", "title", "link")


_CHECKS = ("rolling_sharpe", "hit_rate", "information_coefficient", "prediction_bias")


@query("SELECT DATE '2001-12-31' AS date, " + ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}, max(CASE WHEN metric = '{m}' THEN status END) AS {m}_status" for m in _CHECKS)
       + ", count(*) FILTER (status = 'alert') AS alerts FROM (" + SQL["health_report"] + ") h")
def health_row(spark, sf_dir):
    """The day's checks as one wide row."""
    return ev.health_history(health_report(spark, sf_dir), "2001-12-31").select("date", *[c for m in _CHECKS for c in (m, f"{m}_status")], "alerts")


@query()
def bootstrap_sharpe(spark, sf_dir):
    """The interval of the Sharpe ratio of daily means of returns."""
    daily = ts.with_returns(fx.bars(spark, sf_dir)).groupBy("date").agg(F.avg("log_return_1d").alias("ret"))
    return ev.bootstrap_moments(daily, "ret", ["date"], ev.sharpe_of_sums)


@query(SQL["read_feed_items"])
def landed_feed_items(spark, sf_dir):
    """The items of read_feed_items from XML files, scanned by element."""
    path = work_folder(spark, "feeds")
    p = fx.read(spark, sf_dir, "pages")
    rows = p.select(F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("url").alias("link"), F.when(F.col("page_id") % 3 == 0, F.date_format(_page_time(), "EEE, dd MMM yyyy HH:mm:ss Z")).alias("pubDate"),
                    F.when(F.col("page_id") % 3 == 1, F.date_format(_page_time(), "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("updated"))
    rows.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    out = feeds.feed_items(feeds.landed_items(spark, path), "pages", F.lit("1999-01-01 00:00:00").cast("timestamp"))
    return out.select("article_id", "title", "link", F.col("published_at").cast("timestamp_ntz"))
