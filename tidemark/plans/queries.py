"""Registered queries of the market-news operators, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.operators import feeds, joins, portfolio, stats, timeseries as ts, writes
from tidemark.sources import fixtures as fx

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Added before a value is rounded for comparison, so that decimal ties don't hang on the last bit.
OFF = 3.14159e-8


def settled(col, digits=5):
    return F.round((F.col(col) if isinstance(col, str) else col) + OFF, digits)


def rounded(df, digits=5):
    return df.select(*[settled(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(sql, digits=5):
    return f"round(({sql}) + {OFF}, {digits}) + 0.0"


def flagship(spark, sf_dir):
    return ts.technical_features(fx.bars(spark, sf_dir, "l_returnflag"))


W = "PARTITION BY symbol ORDER BY date"
UP = ("list_sum(list_transform(range(1, len(closes)), lambda i: greatest({s} * (closes[i + 1] - closes[i]), 0.0) * CASE WHEN i = 1 THEN pow(13 / 14.0, len(closes) - 2) "
      "ELSE pow(13 / 14.0, len(closes) - 1 - i) / 14.0 END))")
RSI = f"""CASE WHEN len(closes) > 14 THEN round(CASE WHEN {UP.format(s='1')} < 1e-10 AND {UP.format(s='-1')} < 1e-10 THEN 50.0 WHEN {UP.format(s='-1')} < 1e-10 THEN 100.0
 ELSE 100 - 100 / (1 + {UP.format(s='1')} / {UP.format(s='-1')}) END, 4) END"""


@query(f"WITH {fx.INDICATORS} SELECT symbol, date, {r(RSI, 3)} AS rsi_14, {r('ma_20')} AS ma_20, {r('ma_50')} AS ma_50, {r('round(close / ma_20 - 1, 6)')} AS price_to_ma20, {r('vol_20d')} AS vol_20d, "
       f"{r('rel_volume')} AS rel_volume, {r('bb_position')} AS bb_position, {r('lag_ret_1d')} AS lag_ret_1d, {r('lag_ret_2d')} AS lag_ret_2d FROM ind WHERE recent >= 60")
def technical_features(spark, sf_dir):
    df = ts.technical_features(fx.bars(spark, sf_dir))
    return df.select(*[settled(c, 3 if c == "rsi_14" else 5).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _indicator(name, column, sql, base=fx.RETS, src="rets"):
    def run(spark, sf_dir):
        return rounded(ts.with_returns(fx.bars(spark, sf_dir)).select("symbol", "date", column().alias(name)), 5)

    run.__name__ = name
    query(f"WITH {base} SELECT symbol, date, {r(sql)} AS {name} FROM {src}")(run)


for _n, _c, _s in (
    ("log_return", ts.log_return, "log_return_1d"),
    ("sma_20", lambda: ts.sma(20), f"CASE WHEN count(close) OVER ({W} ROWS 19 PRECEDING) = 20 THEN avg(close) OVER ({W} ROWS 19 PRECEDING) END"),
    ("sma_50", lambda: ts.sma(50), f"CASE WHEN count(close) OVER ({W} ROWS 49 PRECEDING) = 50 THEN avg(close) OVER ({W} ROWS 49 PRECEDING) END"),
    ("price_to_ma", ts.price_to_ma, f"CASE WHEN count(close) OVER ({W} ROWS 19 PRECEDING) = 20 THEN round(close / avg(close) OVER ({W} ROWS 19 PRECEDING) - 1, 6) END"),
    ("realised_vol", ts.realised_vol, f"CASE WHEN count(*) OVER ({W} ROWS 19 PRECEDING) = 20 THEN stddev_samp(log_return_1d) OVER ({W} ROWS 19 PRECEDING) * sqrt(252.0) END"),
    ("relative_volume", ts.relative_volume, f"CASE WHEN count(*) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN volume / avg(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END"),
    ("lag_returns", lambda: ts.lag_return(2), f"lag(log_return_1d, 2) OVER ({W})"),
    ("cumulative_return", lambda: ts.running_sum("log_return_1d"), f"sum(log_return_1d) OVER ({W} ROWS UNBOUNDED PRECEDING)"),
    ("compound_value", lambda: 1000 * F.exp(ts.running_sum("log_return_1d")), f"1000 * exp(sum(log_return_1d) OVER ({W} ROWS UNBOUNDED PRECEDING))"),
    ("drawdown", ts.drawdown, f"close / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1"),
    ("momentum_63", ts.momentum, f"CASE WHEN count(*) OVER ({W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) = 63 THEN sum(log_return_1d) OVER ({W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) END"),
    ("momentum_skip", ts.momentum_skip, f"ln(lag(close, 21) OVER ({W}) / lag(close, 126) OVER ({W}))"),
    ("high_ratio", ts.high_ratio, f"CASE WHEN count(*) OVER ({W} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) = 252 THEN close / max(close) OVER ({W} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) END"),
    ("rolling_sharpe", lambda: ts.rolling_sharpe("log_return_1d"), f"CASE WHEN count(*) OVER ({W} ROWS 29 PRECEDING) = 30 AND stddev_samp(log_return_1d) OVER ({W} ROWS 29 PRECEDING) > 0 THEN avg(log_return_1d) OVER ({W} ROWS 29 PRECEDING) * 252 / (stddev_samp(log_return_1d) OVER ({W} ROWS 29 PRECEDING) * sqrt(252.0)) ELSE 0.0 END"),
    ("month_start_flag", ts.month_start, "CAST(row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date) = 1 AS INTEGER)"),
):
    _indicator(_n, _c, _s)


@query(f"WITH {fx.INDICATORS} SELECT symbol, date, {r('bb_position')} AS bollinger_position FROM ind")
def bollinger_position(spark, sf_dir):
    return fx.bars(spark, sf_dir).select("symbol", "date", settled(ts.bollinger_position()).alias("bollinger_position"))


@query(f"WITH {fx.INDICATORS} SELECT symbol, date, {r(RSI, 3)} AS rsi_wilder FROM ind")
def rsi_wilder(spark, sf_dir):
    return ts.with_rsi(fx.bars(spark, sf_dir)).select("symbol", "date", settled(F.col("rsi_14"), 3).alias("rsi_wilder"))


@query(f"WITH {fx.BARS} SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT date FROM bars)")
def date_index(spark, sf_dir):
    return ts.date_index(fx.bars(spark, sf_dir))


@query(f"WITH {fx.RETS} SELECT date, {r('avg(log_return_1d)')} AS ret FROM rets GROUP BY 1")
def equal_weight_return(spark, sf_dir):
    return ts.with_returns(fx.bars(spark, sf_dir)).groupBy("date").agg(settled(F.avg("log_return_1d")).alias("ret"))


@query(f"""WITH {fx.BARS}, probes AS (SELECT DISTINCT symbol, date FROM (SELECT p_brand AS symbol, CAST(d AS DATE) AS date FROM (SELECT DISTINCT p_brand FROM part) , generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY) t(d)))
 SELECT p.symbol, p.date, CASE WHEN p.date - b.date <= 2 THEN b.date END AS source_date, CASE WHEN p.date - b.date <= 2 THEN b.close END AS close FROM probes p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.date >= b.date""")
def asof_backward(spark, sf_dir):
    b = fx.bars(spark, sf_dir)
    grid = joins.symbol_date_grid(fx.read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")), "1996-01-01", "1996-12-31")
    return joins.asof_backward(grid, b, ["close"], 2)


@query(f"""WITH {fx.BARS} SELECT p.symbol, p.date, CASE WHEN b.date - p.date <= 3 THEN b.date END AS source_date, CASE WHEN b.date - p.date <= 3 THEN b.open END AS open, CASE WHEN b.date - p.date <= 3 THEN b.close END AS close
 FROM bars p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.date < b.date""")
def asof_forward(spark, sf_dir):
    b = fx.bars(spark, sf_dir)
    return joins.asof_forward(b, b, ["open", "close"], 3)


@query(f"""WITH {fx.BARS} SELECT p.symbol, p.date, CASE WHEN b.date - p.date <= 7 AND b.open > 0 THEN round(ln(b.close / b.open), 8) END AS target_ret_1d
 FROM bars p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.date < b.date""")
def label_next_session(spark, sf_dir):
    b = fx.bars(spark, sf_dir)
    return joins.asof_forward(b, b, ["open", "close"], 7).select("symbol", "date", F.when(F.col("open") > 0, F.round(F.log(F.col("close") / F.col("open")), 8)).alias("target_ret_1d"))


@query(f"""WITH {fx.ARTICLES}, {fx.SESSIONS}, l AS (SELECT article_id, published_at + INTERVAL 330 MINUTES AS t FROM articles)
 SELECT article_id, (SELECT min(session_date) FROM sessions WHERE CASE WHEN strftime(l.t, '%H:%M:%S') <= '15:30:00' THEN session_date >= CAST(l.t AS DATE) ELSE session_date > CAST(l.t AS DATE) END) AS trading_date FROM l""")
def assign_session_date(spark, sf_dir):
    return joins.assign_session_date(fx.articles(spark, sf_dir), fx.sessions(spark)).select("article_id", "trading_date")


TAGS = fx.ARTICLES + f""", tag_h AS (SELECT article_id, regexp_extract_all(lower(title || ' ' || summary), '\\b({'|'.join(sorted((a for a, _ in fx.ALIASES), key=lambda a: (-len(a), a)))})\\b', 1) AS h FROM articles),
 tag_hits AS (SELECT article_id, unnest(h) AS keyword, generate_subscripts(h, 1) AS pos FROM tag_h), aliases(keyword, symbol) AS (VALUES {", ".join(f"('{a}', '{s}')" for a, s in fx.ALIASES)}),
 tags AS (SELECT article_id, symbol, arg_min(keyword, pos) AS match_keyword FROM tag_hits JOIN aliases USING (keyword) GROUP BY 1, 2)"""


@query(f"WITH {TAGS} SELECT article_id, symbol, match_keyword FROM tags")
def tag_symbols(spark, sf_dir):
    a = fx.articles(spark, sf_dir)
    return joins.tag_symbols(a, fx.ALIASES, tx.article_text(F.col("title"), F.col("summary")))


@query(f"WITH {fx.BARS} SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'")
def read_table(spark, sf_dir):
    return fx.bars(spark, sf_dir).where(F.col("date").between("1996-03-01", "1996-03-31")).select("symbol", "date", "close")


_OLD, _NEW = "(SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P')", "(SELECT o_orderkey AS k, 'N' AS s, o_totalprice + 1 AS v FROM orders WHERE o_orderstatus <> 'F')"


def _old_new(spark, sf_dir):
    o = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    # Every order is in one of the tables, the open ones in both.
    return o.where("s != 'P'"), o.where("s != 'F'").select("k", F.lit("N").alias("s"), (F.col("v") + 1).alias("v"))


@query(f"SELECT * FROM {_NEW} WHERE k NOT IN (SELECT k FROM {_OLD})")
def insert_new(spark, sf_dir):
    return writes.insert_new(*_old_new(spark, sf_dir), ["k"])


@query(f"SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_OLD} WHERE k NOT IN (SELECT k FROM {_NEW})")
def upsert(spark, sf_dir):
    return writes.upsert(*_old_new(spark, sf_dir), ["k"])


@query(f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} WHERE k NOT IN (SELECT k FROM {_OLD})")
def insert_or_ignore(spark, sf_dir):
    return writes.insert_or_ignore(*_old_new(spark, sf_dir), ["k"])


@query(f"SELECT o.k, o.s, coalesce(n.v, o.v) AS v FROM {_OLD} o LEFT JOIN {_NEW} n ON o.k = n.k")
def update_from(spark, sf_dir):
    return writes.update_from(*_old_new(spark, sf_dir), ["k"], ["v"])


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) r FROM events) WHERE r = 1")
def dedup_by_key(spark, sf_dir):
    return writes.dedup_by_key(fx.read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_type", "user_id", "event_id")


@query(f"SELECT k FROM {_NEW} WHERE k NOT IN (SELECT k FROM {_OLD})")
def only_missing(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return joins.only_missing(new.select("k"), old, ["k"])


@query(f"SELECT k FROM {_NEW} WHERE k IN (SELECT k FROM {_OLD})")
def keep_existing(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return joins.keep_existing(new.select("k"), old, ["k"])


def _text_query(name, column, sql, table="documents", key="doc_id"):
    def run(spark, sf_dir):
        src = fx.articles(spark, sf_dir) if table == "articles" else fx.read(spark, sf_dir, table)
        return src.select(key, column().alias(name))

    run.__name__ = name
    query(f"WITH {fx.ARTICLES} SELECT {key}, {sql} AS {name} FROM {table}")(run)


for _n, _c, _s, _t, _k in (
    ("hash_id", lambda: tx.hash_id("source", "doc_id"), "sha1(concat_ws('|', coalesce(source, ''), coalesce(CAST(doc_id AS VARCHAR), '')))", "documents", "doc_id"),
    ("strip_tags", lambda: tx.strip_tags(F.col("html")), "regexp_replace(html, '<[^>]+>', '', 'g')", "pages", "page_id"),
    ("slug", lambda: tx.slug(F.col("title")), "substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 30)", "articles", "article_id"),
    ("article_text", lambda: tx.article_text(F.col("title"), F.col("summary")), "title || ' ' || coalesce(summary, '')", "articles", "article_id"),
    ("local_time", lambda: tx.local_time(F.col("published_at")), "published_at + INTERVAL 330 MINUTES", "articles", "article_id"),
    ("log1p_scale", lambda: F.round(F.log1p("n_chars"), 6), "round(ln(1 + n_chars), 6)", "documents", "doc_id"),
    ("clip", lambda: tx.clip(F.col("value"), 10.0, 50.0), "greatest(least(value, 50.0), 10.0)", "events", "event_id"),
    ("serial_day", lambda: tx.serial_day(F.to_date("ts")), "CAST(CAST(ts AS DATE) - DATE '1899-12-30' AS INTEGER)", "events", "event_id"),
    ("char_shingles", lambda: F.size(tx.char_shingles(F.col("title"))), "CAST(len(list_distinct(list_transform(range(1, greatest(length(title) - 1, 2)), lambda i: substr(lower(title), i, 3)))) AS INTEGER)", "articles", "article_id"),
):
    _text_query(_n, _c, _s, _t, _k)


@query("SELECT page_id, url FROM pages WHERE NOT coalesce(regexp_matches(lower(html), 'captcha|access denied'), false)")
def drop_blocked_pages(spark, sf_dir):
    return feeds.drop_blocked_pages(fx.read(spark, sf_dir, "pages")).select("page_id", "url")


@query("SELECT event_id, " + ", ".join(f"CAST(isodow(ts) = {k + 1} AS DOUBLE) AS dow_{d}" for k, d in enumerate(("mon", "tue", "wed", "thu", "fri"))) + " FROM events")
def dow_one_hot(spark, sf_dir):
    return fx.read(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in tx.dow_one_hot(F.to_date("ts")).items()])


@query(f"WITH {fx.ARTICLES} SELECT source, count(*) AS n, min(published_at) AS first_at, max(published_at) AS last_at FROM articles GROUP BY 1")
def source_coverage(spark, sf_dir):
    return fx.articles(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


@query(f"WITH {fx.BARS} SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date FROM bars")
def data_coverage(spark, sf_dir):
    return fx.bars(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts(spark, sf_dir):
    parts = [fx.read(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("orders", "events", "documents")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SIGNALS = fx.PREDICTIONS + """, z AS (SELECT *, round(pred_ret / greatest(coalesce(vol_20d, 0.15), 0.005), 6) AS z_score FROM predictions),
 sig0 AS (SELECT symbol, date, pred_ret, z_score, CASE WHEN z_score > 0.05 THEN 'LONG' WHEN z_score < -0.05 THEN 'SHORT' ELSE 'FLAT' END AS signal, round(close * exp(pred_ret), 2) AS pred_close FROM z),
 signals AS (SELECT *, CASE WHEN signal = 'FLAT' THEN 0.0 ELSE round(least(abs(z_score) / 2, 0.10), 4) END AS position_size FROM sig0)"""


def _signals(spark, sf_dir):
    return portfolio.signals(fx.predictions(spark, sf_dir), threshold=0.05)


@query(f"WITH {SIGNALS} SELECT symbol, date, {r('z_score', 4)} + 0.0 AS z_score, signal, {r('position_size', 3)} AS position_size FROM signals")
def signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("symbol", "date", settled("z_score", 4).alias("z_score"), "signal", settled("position_size", 3).alias("position_size"))


_TOP = """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, signal ORDER BY CASE WHEN signal = 'LONG' THEN -z_score ELSE z_score END, symbol) r FROM signals) WHERE signal = 'FLAT' OR r <= 5)"""


@query(f"WITH {SIGNALS}{_TOP} SELECT symbol, date, signal FROM top")
def top_signals(spark, sf_dir):
    return portfolio.top_signals(_signals(spark, sf_dir)).select("symbol", "date", "signal")


_TRADES = """, steps AS (SELECT symbol, date, close AS entry_price, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS exit_date, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS exit_price
  FROM bars WHERE date IN (SELECT date FROM signals)),
 trades AS (SELECT t.symbol, t.date, t.signal, t.position_size, entry_price, exit_date, exit_price, round(ln(exit_price / entry_price), 8) AS actual_ret,
  CASE WHEN exit_date IS NULL THEN 'open' ELSE 'closed' END AS status FROM top t JOIN steps USING (symbol, date) WHERE signal <> 'FLAT')"""


def _trades(spark, sf_dir):
    return portfolio.round_trip_trades(portfolio.top_signals(_signals(spark, sf_dir)), fx.bars(spark, sf_dir))


@query(f"WITH {SIGNALS}{_TOP}{_TRADES} SELECT symbol, date, signal, exit_date, entry_price, exit_price, {r('actual_ret', 6)} AS actual_ret, status FROM trades")
def round_trip_trades(spark, sf_dir):
    return _trades(spark, sf_dir).select("symbol", "date", "signal", "exit_date", "entry_price", "exit_price", settled("actual_ret", 6).alias("actual_ret"), "status")


@query(f"WITH {SIGNALS}{_TOP}{_TRADES} SELECT symbol, count(*) AS n, round(sum(1e6 * position_size * (CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END) * actual_ret - 1e6 * position_size * 0.002), 0) AS pnl_net FROM trades WHERE status = 'closed' GROUP BY 1")
def pnl_by_symbol(spark, sf_dir):
    return portfolio.trade_pnl(_trades(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("pnl_net"), 0).alias("pnl_net"))


@query(f"""WITH {SIGNALS}{_TOP}{_TRADES}, daily AS (SELECT exit_date AS date, count(*) AS n_trades, sum(position_size * ((CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END) * actual_ret - 0.002)) AS ret FROM trades WHERE status = 'closed' GROUP BY 1)
 SELECT date, n_trades, {r('round(ret, 8)', 4)} AS daily_return, {r('round(exp(sum(ln(1 + ret)) OVER (ORDER BY date)) - 1, 8)', 4)} AS cum_return FROM daily""")
def equity_curve(spark, sf_dir):
    return portfolio.equity_curve(_trades(spark, sf_dir)).select("date", "n_trades", settled("daily_return", 4).alias("daily_return"), settled("cum_return", 4).alias("cum_return"))


@query(f"WITH {fx.RETS} SELECT symbol, round(avg(log_return_1d) / stddev_samp(log_return_1d) * sqrt(252.0), 6) AS sharpe, round(avg(log_return_1d) / stddev_samp(CASE WHEN log_return_1d < 0 THEN log_return_1d END) * sqrt(252.0), 6) AS sortino FROM rets GROUP BY 1")
def sharpe_sortino(spark, sf_dir):
    x = F.col("log_return_1d")
    return ts.with_returns(fx.bars(spark, sf_dir)).groupBy("symbol").agg(F.round(portfolio.sharpe(x), 6).alias("sharpe"), F.round(portfolio.sortino(x), 6).alias("sortino"))


@query(f"WITH {fx.RETS} SELECT symbol, round(stddev_samp(log_return_1d), 6) AS std, round(skewness(log_return_1d), 5) AS skew, round(kurtosis(log_return_1d), 5) AS excess_kurtosis FROM rets GROUP BY 1")
def return_moments(spark, sf_dir):
    m = stats.moments(F.col("log_return_1d"))
    return ts.with_returns(fx.bars(spark, sf_dir)).groupBy("symbol").agg(F.round(m["std"], 6).alias("std"), F.round(m["skew"], 5).alias("skew"), F.round(m["excess_kurtosis"], 5).alias("excess_kurtosis"))


@query("SELECT event_type, median(value) AS med FROM events GROUP BY 1")
def column_medians(spark, sf_dir):
    return stats.medians(fx.read(spark, sf_dir, "events"), "value", ["event_type"])


@query(f"""WITH {fx.PREDICTIONS}, p AS (SELECT pr.symbol, pred_ret AS p, r.log_return_1d AS a FROM predictions pr JOIN rets r USING (symbol, date))
 SELECT symbol, {r('avg(abs(p - a))')} AS mae, {r('sqrt(avg((p - a) * (p - a)))')} AS rmse, {r('avg(CAST(sign(p) = sign(a) AS DOUBLE))')} AS hit_rate, {r('corr(p, a)')} AS ic FROM p GROUP BY 1""")
def forecast_metrics(spark, sf_dir):
    rets = ts.with_returns(fx.bars(spark, sf_dir)).select("symbol", "date", "log_return_1d")
    m = portfolio.forecast_metrics(F.col("pred_ret"), F.col("log_return_1d"))
    return fx.predictions(spark, sf_dir).join(rets, ["symbol", "date"]).groupBy("symbol").agg(*[settled(c).alias(k) for k, c in m.items()])


@query(f"""WITH {fx.RETS}, m AS (SELECT symbol, date, CASE WHEN count(*) OVER w = 63 THEN round(sum(log_return_1d) OVER w, 7) END AS score FROM rets WINDOW w AS ({W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
 r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS u, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS d FROM m WHERE score IS NOT NULL)
 SELECT symbol, date, CASE WHEN u <= 5 THEN 'long' WHEN d <= 5 THEN 'short' END AS leg FROM r""")
def rank_legs(spark, sf_dir):
    s = ts.with_returns(fx.bars(spark, sf_dir)).select("symbol", "date", F.round(ts.momentum(), 7).alias("score"))
    return portfolio.rank_legs(s).select("symbol", "date", "leg")


@query("""WITH s AS (SELECT CAST(event_id % 2 AS INTEGER) AS side, value AS x FROM events WHERE value IS NOT NULL), r AS (SELECT min(x) lo, max(x) hi FROM s),
 c AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS q FROM s, r GROUP BY 1),
 g AS (SELECT coalesce(p, 0) + 1e-9 AS p, coalesce(q, 0) + 1e-9 AS q FROM range(20) t(b) LEFT JOIN c ON c.bin = b), t AS (SELECT sum(p) sp, sum(q) sq FROM g)
 SELECT round(sum(p / sp * ln((p / sp) / (q / sq))), 6) AS kl FROM g, t""")
def histogram_kl(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events").where("value is not null").select((F.col("event_id") % 2).cast("int").alias("side"), F.col("value").alias("x"))
    return stats.histogram_kl(e)


@query(f"WITH {fx.BARS} SELECT symbol, max(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY 1")
def latest_bar(spark, sf_dir):
    return fx.bars(spark, sf_dir).groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


@query(f"WITH {fx.BARS} SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) r, count(*) OVER (PARTITION BY symbol) n FROM bars) WHERE r <= 30 AND n >= 30")
def last_n_rows(spark, sf_dir):
    w = Window.partitionBy("symbol")
    b = fx.bars(spark, sf_dir).withColumns({"r": F.row_number().over(w.orderBy(F.col("date").desc())), "n": F.count("*").over(w)})
    return b.where("r <= 30 and n >= 30").select("symbol", "date", "close")


@query("SELECT date_trunc('minute', time_bucket(INTERVAL 30 MINUTES, ts)) AS at, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts_batch(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "30 minutes")["start"].alias("at"), "event_type").agg(F.count("*").alias("n"))


def _all():
    from tidemark.plans import assembling, modelling, refitting, research  # noqa: F401  they add their queries

    return QUERIES, SQL


def queries():
    return dict(_all()[0])


def oracle_sql():
    return dict(_all()[1])
