"""Registered queries of feature assembly, factor legs, portfolio figures and readers, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import assembly, evaluation as ev, joins, news, portfolio, readers, timeseries as ts
from tidemark.operators.lineage import checkpointed
from tidemark.plans.queries import RSI, SIGNALS, TAGS, _TOP, _TRADES, _signals, _trades, query, r, settled
from tidemark.plans.research import SCORES, _item
from tidemark.sources import fixtures as fx
from tidemark.streaming.counts import work_folder

FIRST, FINAL, DAY = "1998-01-01", "1998-06-30", "1998-05-29"

# --- tagged news and features -------------------------------------------------------------------------------------


def _tags(spark, sf_dir):
    return joins.tag_symbols(fx.articles(spark, sf_dir), fx.ALIASES, _item())


def _tagged(spark, sf_dir, **days):
    rows = fx.articles(spark, sf_dir).withColumn("trading_date", F.to_date("published_at"))
    return assembly.tagged_news(_tags(spark, sf_dir), rows, **days)


@query(f"WITH {TAGS} SELECT symbol, article_id, match_keyword, CAST(published_at AS DATE) AS trading_date FROM tags JOIN articles USING (article_id) WHERE CAST(published_at AS DATE) BETWEEN DATE '1998-02-01' AND DATE '1998-03-31'")
def tagged_news(spark, sf_dir):
    return _tagged(spark, sf_dir, first="1998-02-01", final="1998-03-31").select("symbol", "article_id", "match_keyword", "trading_date")


@query(f"WITH {TAGS} SELECT symbol, count(DISTINCT article_id) AS n FROM tags GROUP BY 1")
def articles_by_symbol(spark, sf_dir):
    return assembly.articles_by_symbol(_tags(spark, sf_dir))


_SCORED = SCORES[len(fx.ARTICLES):]
DAILY = TAGS + _SCORED + """, k AS (SELECT s.*, t.symbol, CAST(published_at AS DATE) AS trading_date FROM scores s JOIN tags t USING (article_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY symbol, trading_date ORDER BY published_at DESC, article_id DESC) AS rn FROM k),
 daily AS (SELECT symbol, trading_date AS date, round(avg(pos) FILTER (rn <= 32), 6) AS sent_pos, round(avg(neg) FILTER (rn <= 32), 6) AS sent_neg, round(avg(neu) FILTER (rn <= 32), 6) AS sent_neu,
  round(avg(pos) FILTER (rn <= 32) - avg(neg) FILTER (rn <= 32), 6) AS sent_spread, count(*) AS news_count FROM n GROUP BY 1, 2)"""


def _sentiment(spark, sf_dir):
    return news.sentiment_daily(_tagged(spark, sf_dir).select("symbol", "trading_date", "article_id", "published_at", _item().alias("text")))


IND = fx.INDICATORS
FEATURES = DAILY + ", " + IND + f""", grid AS (SELECT symbol, date FROM bars WHERE date BETWEEN DATE '{FIRST}' AND DATE '{FINAL}'),
 tech AS (SELECT symbol, date, {RSI} AS rsi_14, ma_20, ma_50, round(close / ma_20 - 1, 6) AS price_to_ma20, vol_20d, rel_volume, bb_position, lag_ret_1d, lag_ret_2d FROM ind WHERE recent >= 60),
 near AS (SELECT g.symbol, g.date, CASE WHEN g.date - d.date <= 5 THEN d.date END AS at FROM grid g ASOF LEFT JOIN daily d ON g.symbol = d.symbol AND g.date >= d.date),
 features AS (SELECT g.symbol, g.date, coalesce(sent_pos, 1.0 / 3) AS sent_pos, coalesce(sent_neg, 1.0 / 3) AS sent_neg, coalesce(sent_neu, 1.0 / 3) AS sent_neu, coalesce(sent_spread, 0.0) AS sent_spread,
  ln(1 + coalesce(news_count, 0)) AS news_count, t.* EXCLUDE (symbol, date), {", ".join(f"CAST(isodow(g.date) = {k + 1} AS DOUBLE) AS dow_{d}" for k, d in enumerate(("mon", "tue", "wed", "thu", "fri")))},
  CAST(NULL AS DOUBLE) AS target_ret_1d FROM near g LEFT JOIN daily d ON g.symbol = d.symbol AND g.at = d.date LEFT JOIN tech t ON g.symbol = t.symbol AND g.date = t.date)"""


def _features(spark, sf_dir):
    bars = fx.bars(spark, sf_dir)
    return assembly.feature_matrix(bars.where(F.col("date").between(FIRST, FINAL)), _sentiment(spark, sf_dir), ts.technical_features(bars))


_EXACT = ("symbol", "date", *assembly.DAYS)
_CELLS = [c for c in (*assembly.SENTIMENT, *assembly.TECHNICAL, *assembly.DAYS, "target_ret_1d")]


def _digits(c):
    return 3 if c == "rsi_14" else 4


def _shown(df, columns):
    return df.select(*[F.col(c) if c in _EXACT or c == "target_ret_1d" else settled(c, _digits(c)).alias(c) for c in columns])


def _sql_cells(columns):
    return ", ".join(c if c in _EXACT or c == "target_ret_1d" else f"{r(c, _digits(c))} AS {c}" for c in columns)


@query(f"WITH {FEATURES} SELECT {_sql_cells(['symbol', 'date', *_CELLS])} FROM features")
def feature_matrix(spark, sf_dir):
    return _shown(_features(spark, sf_dir), ["symbol", "date", *_CELLS])


_MODEL = ["symbol", "date", *assembly.MODEL, "target_ret_1d"]


@query(f"""WITH {FEATURES}, targets AS (SELECT p.symbol, p.date, CASE WHEN b.date - p.date <= 7 AND b.open > 0 THEN round(ln(b.close / b.open), 8) END AS target
  FROM bars p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.date < b.date)
 SELECT {_sql_cells(_MODEL[:-1])}, {r('target', 6)} AS target_ret_1d FROM features JOIN targets USING (symbol, date) WHERE target IS NOT NULL""")
def labelled_rows(spark, sf_dir):
    from tidemark.operators import writes

    b = fx.bars(spark, sf_dir)
    ahead = joins.asof_forward(b, b, ["open", "close"], 7)
    targets = ahead.select("symbol", "date", F.when(F.col("open") > 0, F.round(F.log(F.col("close") / F.col("open")), 8)).alias("target_ret_1d"))
    rows = assembly.labelled_rows(writes.update_from(_features(spark, sf_dir), targets, ["symbol", "date"], ["target_ret_1d"]))
    return _shown(rows, _MODEL[:-1] + ["target_ret_1d"]).withColumn("target_ret_1d", settled("target_ret_1d", 6))


@query(f"WITH {DAILY}, {IND} SELECT d.symbol, d.date, {r('sent_spread', 4)} AS sent_spread, {r('ma_20', 4)} AS ma_20 FROM daily d LEFT JOIN ind i USING (symbol, date)")
def features_left_join(spark, sf_dir):
    ma = fx.bars(spark, sf_dir).select("symbol", "date", ts.sma(20).alias("ma_20"))
    out = assembly.features_left_join(_sentiment(spark, sf_dir).withColumnRenamed("trading_date", "date"), ma)
    return out.select("symbol", "date", settled("sent_spread", 4).alias("sent_spread"), settled("ma_20", 4).alias("ma_20"))


# --- prices and series --------------------------------------------------------------------------------------------

_THREE = ("Brand#11", "Brand#4", "Brand#7")


@query(f"WITH {fx.BARS} SELECT symbol, date, round(open * 1.0013, 4) AS open, round(high * 1.0013, 4) AS high, round(low * 1.0013, 4) AS low, round(close * 1.0013, 4) AS close, volume FROM bars WHERE symbol IN {_THREE}")
def wide_prices_to_bars(spark, sf_dir):
    fields = ("open", "high", "low", "close", "volume")
    wide = fx.bars(spark, sf_dir).groupBy(F.col("date").cast("timestamp").alias("at")).pivot("symbol", list(_THREE)).agg(  # factor: no decimal ties
        *[(F.first(f) if f == "volume" else F.first(f) * 1.0013).alias(f) for f in fields])
    columns = {(s, f): f"`{s}_{f}`" for s in _THREE for f in fields}
    return assembly.wide_prices_to_bars(wide, "at", columns)


@query(f"WITH {fx.BARS} SELECT a.symbol, a.date + 1 AS date, b.close AS price FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.date = a.date + 1")
def price_lookup(spark, sf_dir):
    b = fx.bars(spark, sf_dir)
    return assembly.price_lookup(b.select("symbol", F.date_add("date", 1).alias("date")), b).select("symbol", "date", "price")


_SERIES = fx.RETS + """, market AS (SELECT date, avg(log_return_1d) AS ret FROM rets GROUP BY 1), one AS (SELECT date, log_return_1d AS ret FROM rets WHERE symbol = 'Brand#11'),
 two AS (SELECT date, log_return_1d AS ret FROM rets WHERE symbol = 'Brand#4')"""


def _series(spark, sf_dir):
    rets = ts.with_returns(fx.bars(spark, sf_dir)).select("symbol", "date", F.col("log_return_1d").alias("ret"))
    return rets.groupBy("date").agg(F.avg("ret").alias("ret")), *[rets.where(F.col("symbol") == s).select("date", "ret") for s in ("Brand#11", "Brand#4")]


@query(f"WITH {_SERIES} SELECT date, {r('market.ret')} AS market, {r('one.ret')} AS one, {r('two.ret')} AS two FROM market JOIN one USING (date) JOIN two USING (date)")
def align_series(spark, sf_dir):
    out = assembly.align_series(dict(zip(("market", "one", "two"), _series(spark, sf_dir), strict=True)))
    return out.select("date", *[settled(c).alias(c) for c in ("market", "one", "two")])


@query(f"WITH {_SERIES} SELECT date, {r('coalesce(two.ret, 0.0)')} AS ret FROM one LEFT JOIN two USING (date)")
def reindex_fill(spark, sf_dir):
    _, one, two = _series(spark, sf_dir)
    return assembly.reindex_fill(one.select("date"), two, ["ret"]).withColumn("ret", settled("ret"))


@query(f"""WITH s AS (SELECT DISTINCT event_type AS source FROM events), w AS (SELECT CAST(d AS DATE) AS week_start FROM generate_series(DATE '2023-12-20', DATE '2024-03-10', INTERVAL 7 DAY) t(d)),
 p AS (SELECT source, week_start, least(week_start + 6, DATE '2024-03-10') AS week_end, source || '|' || isoyear(week_start) || '-W' || lpad(CAST(week(week_start) AS VARCHAR), 2, '0') AS key FROM s, w),
 done AS (SELECT DISTINCT event_type || '|' || isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS key FROM events)
 SELECT * FROM p WHERE key NOT IN (SELECT key FROM done WHERE key IS NOT NULL)""")
def backfill_plan(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    week = F.concat("event_type", F.lit("|"), F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return assembly.backfill_plan(e.select(F.col("event_type").alias("source")).where("source is not null"), "2023-12-20", "2024-03-10", e.select(week.alias("key")))


@query(f"WITH {IND}, n AS (SELECT symbol, max(date) AS date FROM bars WHERE date <= DATE '{DAY}' GROUP BY 1) SELECT n.symbol, n.date, close, {r('vol_20d')} AS vol_20d FROM n JOIN ind USING (symbol, date)")
def latest_bar_join(spark, sf_dir):
    rows = ts.with_returns(fx.bars(spark, sf_dir))
    ind = rows.select("symbol", "date", ts.realised_vol().alias("vol_20d"))
    return assembly.latest_bar_join(rows, ind, ["vol_20d"], DAY).withColumn("vol_20d", settled("vol_20d"))


@query("""WITH runs AS (SELECT o_orderkey AS run_id, 'running' AS status, CAST(NULL AS DOUBLE) AS inserted FROM orders), done AS (SELECT l_orderkey AS run_id, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT run_id, CASE WHEN n IS NULL THEN 'running' ELSE 'success' END AS status, CAST(n AS DOUBLE) AS inserted FROM runs LEFT JOIN done USING (run_id)""")
def run_audit(spark, sf_dir):
    runs = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("running").alias("status"), F.lit(None).cast("double").alias("inserted"), F.lit(None).cast("date").alias("finished_at"))
    ended = fx.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").cast("double").alias("inserted"), F.to_date(F.max("l_shipdate")).alias("finished_at"))
    return assembly.run_audit(runs, ended.withColumn("status", F.lit("success"))).select("run_id", "status", "inserted")


@query("SELECT DISTINCT p_brand AS symbol, CAST(d AS DATE) AS date FROM part, generate_series(DATE '1997-01-01', DATE '1997-03-31', INTERVAL 1 DAY) t(d)")
def symbol_date_grid(spark, sf_dir):
    return joins.symbol_date_grid(fx.read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")), "1997-01-01", "1997-03-31")


@query(f"""WITH {fx.BARS}, g AS (SELECT symbol, date, CASE WHEN volume > 60 THEN close END AS x FROM bars)
 SELECT symbol, date, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING),
  first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM g""")
def ffill_bfill(spark, sf_dir):
    return fx.bars(spark, sf_dir).select("symbol", "date", F.when(F.col("volume") > 60, F.col("close")).alias("x")).select("symbol", "date", ts.fill_gaps("x").alias("x"))


# --- factors ------------------------------------------------------------------------------------------------------

LEGS = fx.RETS + """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars)),
 f AS (SELECT *, date_trunc('month', date) IS DISTINCT FROM date_trunc('month', lag(date) OVER (ORDER BY date)) AS first FROM d),
 hm AS (SELECT date, idx, max(CASE WHEN first AND idx >= 63 THEN date END) OVER (ORDER BY date) AS held FROM f), hv AS (SELECT date, idx, max(CASE WHEN first AND idx >= 252 THEN date END) OVER (ORDER BY date) AS held FROM f),
 ri AS (SELECT symbol, idx, log_return_1d AS ret FROM rets JOIN d USING (date)),
 ms AS (SELECT s.symbol, c.date, round(coalesce(sum(ret), 0.0), 7) AS score FROM (SELECT DISTINCT symbol FROM rets) s CROSS JOIN (SELECT date, idx FROM hm WHERE held = date) c
  LEFT JOIN ri ON ri.symbol = s.symbol AND ri.idx BETWEEN c.idx - 63 AND c.idx - 1 GROUP BY 1, 2),
 vs AS (SELECT b.symbol, date, round(-close / max(close) OVER (PARTITION BY symbol ORDER BY idx RANGE BETWEEN 252 PRECEDING AND 1 PRECEDING), 7) AS score FROM bars b JOIN d USING (date)),
 mr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS u, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS l FROM ms),
 vr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS u, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS l FROM vs WHERE score IS NOT NULL AND date IN (SELECT held FROM hv)),
 ml AS (SELECT hm.date, symbol, CASE WHEN u <= 5 THEN 'long' ELSE 'short' END AS leg FROM hm JOIN mr ON mr.date = hm.held WHERE u <= 5 OR l <= 5),
 vl AS (SELECT hv.date, symbol, CASE WHEN u <= 5 THEN 'long' ELSE 'short' END AS leg FROM hv JOIN vr ON vr.date = hv.held WHERE u <= 5 OR l <= 5),
 mret AS (SELECT date, coalesce(avg(log_return_1d) FILTER (leg = 'long'), 0.0) - coalesce(avg(log_return_1d) FILTER (leg = 'short'), 0.0) AS ret FROM d LEFT JOIN (ml JOIN rets USING (symbol, date)) USING (date) GROUP BY 1),
 vret AS (SELECT date, coalesce(avg(log_return_1d) FILTER (leg = 'long'), 0.0) - coalesce(avg(log_return_1d) FILTER (leg = 'short'), 0.0) AS ret FROM d LEFT JOIN (vl JOIN rets USING (symbol, date)) USING (date) GROUP BY 1)"""


def _factor(spark, sf_dir, kind, bars=None):
    bars = ts.with_returns(fx.bars(spark, sf_dir)) if bars is None else bars
    returns = bars.select("symbol", "date", F.col("log_return_1d").alias("ret"))
    dates = portfolio.rebalance_dates(bars.select("date"), 63 if kind == "momentum" else 252)
    scores = portfolio.momentum_scores(returns, dates) if kind == "momentum" else portfolio.value_scores(bars, dates)
    return portfolio.hold_until_rebalance(scores, dates), returns, dates


@query(f"WITH {LEGS} SELECT * FROM ml")
def hold_until_rebalance(spark, sf_dir):
    return _factor(spark, sf_dir, "momentum")[0]


@query(f"WITH {LEGS} SELECT date, {r('ret')} AS ret FROM vret")
def long_short_factor(spark, sf_dir):
    return portfolio.long_short_factor(*_factor(spark, sf_dir, "value")).withColumn("ret", settled("ret"))


@query(f"""WITH {LEGS}, b AS (SELECT 'equal_weight' AS strategy, date, avg(log_return_1d) AS daily_ret FROM rets GROUP BY 2 UNION ALL SELECT 'momentum', date, ret FROM mret UNION ALL SELECT 'value', date, ret FROM vret)
 SELECT strategy, date, {r('daily_ret')} AS daily_ret, {r('sum(daily_ret) OVER (PARTITION BY strategy ORDER BY date)', 4)} AS cum_ret FROM b""")
def benchmark_series(spark, sf_dir):
    bars = checkpointed(ts.with_returns(fx.bars(spark, sf_dir)))  # one scan for all three
    kinds = {k: portfolio.long_short_factor(*_factor(spark, sf_dir, k, bars)) for k in ("momentum", "value")}
    market = bars.groupBy("date").agg(F.avg("log_return_1d").alias("ret"))
    out = ev.benchmark_series({"equal_weight": market, **kinds})
    return out.select("strategy", "date", settled("daily_ret").alias("daily_ret"), settled("cum_ret", 4).alias("cum_ret"))


# --- portfolio ----------------------------------------------------------------------------------------------------

PNL = f"""WITH {SIGNALS}{_TOP}{_TRADES}, pnl AS (SELECT *, 1e6 * position_size AS alloc, CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END AS side,
  round(round(1e6 * position_size * (CASE WHEN signal = 'LONG' THEN 1.0 ELSE -1.0 END) * actual_ret, 4) - round(1e6 * position_size * 20 / 1e4, 4), 4) AS pnl_net FROM trades)"""


@query(f"{PNL} SELECT exit_date AS date, symbol, round(sum(pnl_net), 0) AS pnl FROM pnl WHERE status = 'closed' GROUP BY 1, 2")
def pnl_heatmap(spark, sf_dir):
    return readers.pnl_heatmap(portfolio.trade_pnl(_trades(spark, sf_dir))).withColumn("pnl", F.round("pnl", 0))


@query(f"{PNL} SELECT symbol, {r('avg(CAST(pnl_net > 0 AS DOUBLE))', 4)} AS hit_rate, {r('coalesce(avg(pnl_net) FILTER (pnl_net > 0) / abs(avg(pnl_net) FILTER (pnl_net < 0)), 0.0)', 3)} AS win_loss FROM pnl WHERE status = 'closed' GROUP BY 1")
def win_loss(spark, sf_dir):
    p = F.col("pnl_net")
    return portfolio.trade_pnl(_trades(spark, sf_dir)).groupBy("symbol").agg(settled(portfolio.hit_rate(p), 4).alias("hit_rate"), settled(portfolio.win_loss(p), 3).alias("win_loss"))


@query(f"""WITH {fx.RETS}, v AS (SELECT symbol, date, close, first_value(close) OVER w AS c0, close / max(close) OVER w - 1 AS dd FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY date)),
 a AS (SELECT symbol, pow(arg_max(close / c0, date), 252.0 / count(*)) - 1 AS ann, min(dd) AS mdd FROM v GROUP BY 1)
 SELECT symbol, {r('ann')} AS annualised_return, {r('CASE WHEN mdd <> 0 THEN ann / abs(mdd) ELSE 0.0 END', 4)} AS calmar FROM a""")
def calmar(spark, sf_dir):
    b = fx.bars(spark, sf_dir).withColumn("dd", ts.drawdown())
    t = b.groupBy("symbol").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("total"), F.count("*").alias("n"), F.min("dd").alias("mdd"))
    t = t.withColumn("ann", portfolio.annualised_return(F.col("total"), F.col("n")))
    return t.select("symbol", settled("ann").alias("annualised_return"), settled(portfolio.calmar(F.col("ann"), F.col("mdd")), 4).alias("calmar"))


_SNAPS = """, day AS (SELECT exit_date AS date, count(*) AS n, count(*) FILTER (signal = 'LONG') AS longs, count(*) FILTER (signal = 'SHORT') AS shorts, sum(pnl_net) AS daily_pnl, sum(alloc * 0.002) AS costs FROM pnl WHERE status = 'closed' GROUP BY 1),
 val AS (SELECT *, 1e6 + sum(daily_pnl) OVER (ORDER BY date) AS value FROM day), snaps AS (SELECT *, value / (value - daily_pnl) - 1 AS ret FROM val),
 peaks AS (SELECT *, (value - max(value) OVER (ORDER BY date)) / max(value) OVER (ORDER BY date) AS dd FROM snaps),
 s AS (SELECT count(*) AS days, arg_max(value, date) AS v, arg_max(daily_pnl, date) AS p, arg_max(ret, date) AS tr, min(dd) AS mdd, stddev_samp(ret) AS sd, avg(ret) AS mu, stddev_samp(ret) FILTER (ret < 0) AS dsd, sum(costs) AS costs,
  arg_max(n, date) AS n, arg_max(longs, date) AS longs, arg_max(shorts, date) AS shorts FROM peaks),
 t AS (SELECT count(*) AS closed, avg(CAST(pnl_net > 0 AS DOUBLE)) AS hit, avg(pnl_net) FILTER (pnl_net > 0) / abs(avg(pnl_net) FILTER (pnl_net < 0)) AS wl FROM pnl WHERE status = 'closed')"""


def _snapshots(closed):
    from pyspark.sql.window import Window

    side = lambda s: F.count_if(F.col("signal") == s)
    day = closed.groupBy(F.col("exit_date").alias("date")).agg(
        F.count("*").alias("open_positions"), side("LONG").alias("longs"), side("SHORT").alias("shorts"), F.sum("pnl_net").alias("daily_pnl"), F.sum("cost").alias("transaction_costs"))
    value = 1e6 + F.sum("daily_pnl").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # one row a day
    return day.withColumn("portfolio_value", value).withColumn("daily_return", F.col("portfolio_value") / (F.col("portfolio_value") - F.col("daily_pnl")) - 1)


@query(f"""{PNL}{_SNAPS} SELECT round(v, 0) AS portfolio_value, round(tr * 100, 3) AS today_return_pct, round((v / 1e6 - 1) * 100, 1) AS total_return_pct, round((pow(v / 1e6, 252.0 / days) - 1) * 100, 1) AS ann_return_pct,
  round(sd * sqrt(252.0) * 100, 1) AS ann_volatility_pct, round(mu / sd * sqrt(252.0), 3) AS sharpe_ratio, round(mu / dsd * sqrt(252.0), 3) AS sortino_ratio, round(mdd * 100, 1) AS max_drawdown_pct,
  CAST(closed AS DOUBLE) AS total_trades, round(hit * 100, 1) AS hit_rate_pct, round(wl, 1) AS win_loss_ratio, round(costs, 0) AS total_costs, CAST(n AS DOUBLE) AS open_positions, CAST(longs AS DOUBLE) AS open_longs,
  CAST(shorts AS DOUBLE) AS open_shorts, CAST(days AS DOUBLE) AS trading_days FROM s, t""")
def portfolio_metrics(spark, sf_dir):
    closed = checkpointed(portfolio.trade_pnl(_trades(spark, sf_dir)))  # for the snapshots and for the figures
    digits = {"portfolio_value": 0, "today_return_pct": 3, "total_return_pct": 1, "ann_return_pct": 1, "ann_volatility_pct": 1, "sharpe_ratio": 3, "sortino_ratio": 3, "max_drawdown_pct": 1, "total_trades": 0,
              "hit_rate_pct": 1, "win_loss_ratio": 1, "total_costs": 0, "open_positions": 0, "open_longs": 0, "open_shorts": 0, "trading_days": 0}
    return portfolio.portfolio_metrics(_snapshots(closed), closed, digits=digits).select(*digits)


@query(f"""{PNL} SELECT p.exit_date AS date, round(sum(alloc * (1 + side * ln(coalesce(b.close, entry_price) / entry_price))), 0) AS value FROM pnl p LEFT JOIN bars b ON b.symbol = p.symbol AND b.date = p.exit_date
 WHERE exit_date IS NOT NULL GROUP BY 1""")
def mark_to_market(spark, sf_dir):
    held = _trades(spark, sf_dir).where("exit_date is not null").select("symbol", F.col("exit_date").alias("date"), "signal", "entry_price", (1e6 * F.col("position_size")).alias("capital_allocated"))
    return portfolio.mark_to_market(held, fx.bars(spark, sf_dir)).withColumn("value", F.round("value", 0))


@query(f"""{PNL}, dd AS (SELECT max(date) FILTER (rn = 1) AS day, max(date) FILTER (rn = 2) AS prev FROM (SELECT date, row_number() OVER (ORDER BY date DESC) AS rn FROM (SELECT DISTINCT date FROM signals))),
 o AS (SELECT t.symbol, t.side, t.alloc, t.entry_price, b.close AS px FROM pnl t, dd JOIN bars b ON b.symbol = t.symbol AND b.date = dd.day WHERE t.date = dd.prev),
 c AS (SELECT coalesce(sum(alloc * side * ln(px / entry_price) - alloc * 0.002), 0.0) AS pnl, coalesce(sum(alloc), 0.0) AS back FROM o),
 k AS (SELECT count(*) AS kept FROM pnl t, dd WHERE t.date = dd.prev AND t.symbol NOT IN (SELECT symbol FROM bars, dd WHERE bars.date = dd.day)),
 w AS (SELECT t.symbol, t.signal, t.z_score, (1e6 + c.pnl) * t.position_size AS wish FROM top t, dd, c WHERE t.date = dd.day AND t.signal <> 'FLAT' AND (1e6 + c.pnl) * t.position_size >= 100),
 xx AS (SELECT *, least(wish, 5e5 + c.back + c.pnl - coalesce(sum(wish) OVER (ORDER BY abs(z_score) DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS a FROM w, c)
 SELECT round(any_value(1e6 + c.pnl), 0) AS portfolio_value, round(any_value(5e5 + c.back + c.pnl) - coalesce(sum(a) FILTER (a >= 100), 0), 0) AS cash, any_value(k.kept) + count(*) FILTER (a >= 100) AS open_positions,
  count(*) FILTER (a >= 100 AND signal = 'LONG') AS longs FROM c, k LEFT JOIN xx ON true""")
def daily_close_out(spark, sf_dir):
    s = portfolio.top_signals(_signals(spark, sf_dir))
    day, prev = [row["date"] for row in s.select("date").distinct().orderBy(F.desc("date")).limit(2).collect()]  # two dates
    held = _trades(spark, sf_dir).where(F.col("date") == prev).select("symbol", "signal", "entry_price", (1e6 * F.col("position_size")).alias("capital_allocated"))
    _, _, snapshot = portfolio.daily_close_out(held, s, fx.bars(spark, sf_dir), str(day), 1e6, 5e5)
    return snapshot.select(F.round("portfolio_value", 0).alias("portfolio_value"), F.round("cash", 0).alias("cash"), "open_positions", "longs")


# --- readers ------------------------------------------------------------------------------------------------------


@query(f"WITH {fx.BARS} SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '{DAY}' - 30 AND DATE '{DAY}'")
def last_n_days(spark, sf_dir):
    return readers.last_n_days(fx.bars(spark, sf_dir), DAY, 30).select("symbol", "date", "close")


@query(f"WITH {SIGNALS}{_TOP}{_TRADES} SELECT symbol, date, signal FROM trades WHERE status = 'closed' AND date BETWEEN DATE '{DAY}' - 90 AND DATE '{DAY}' ORDER BY date DESC, symbol LIMIT 25")
def filter_trades(spark, sf_dir):
    return readers.filter_trades(_trades(spark, sf_dir), status="closed", as_of=DAY, days=90, limit=25).select("symbol", "date", "signal")


@query(f"WITH {SIGNALS}{_TOP}{_TRADES} SELECT symbol, date, exit_date FROM trades ORDER BY date DESC, symbol LIMIT 20")
def recent_trades(spark, sf_dir):
    return readers.newest(_trades(spark, sf_dir), 20, "date", "symbol").select("symbol", "date", "exit_date")


@query("SELECT event_id, substr(event_type, 1, 3) AS event_type, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(value * 100, 1) AS value FROM events")
def display_columns(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    return readers.display_columns(e, ids={"event_type": 3}, times=["ts"], percents=["value"], digits=1)


@query(f"WITH {SIGNALS} SELECT symbol, signal, row_number() OVER (ORDER BY abs(z_score) DESC, symbol) AS rank FROM signals WHERE date = DATE '{DAY}' AND signal <> 'FLAT'")
def signals_by_conviction(spark, sf_dir):
    return readers.signals_by_conviction(_signals(spark, sf_dir), DAY).select("symbol", "signal", F.col("rank").cast("long").alias("rank"))


@query(f"{PNL}{_SNAPS} SELECT date, round(value, 0) AS portfolio_value FROM snaps ORDER BY date DESC LIMIT 1")
def latest_snapshot(spark, sf_dir):
    return readers.latest_snapshot(_snapshots(portfolio.trade_pnl(_trades(spark, sf_dir)))).select("date", F.round("portfolio_value", 0).alias("portfolio_value"))


@query(f"WITH {fx.BARS} SELECT date, open, high, low, close, volume FROM bars WHERE symbol = 'Brand#11' AND date >= DATE '1997-01-01'")
def price_history(spark, sf_dir):
    return readers.history(fx.bars(spark, sf_dir), "Brand#11", ["open", "high", "low", "close", "volume"], "1997-01-01")


@query(f"WITH {fx.BARS}, a AS (SELECT * FROM bars WHERE symbol = 'Brand#11'), b AS (SELECT * FROM bars WHERE symbol = 'Brand#4') SELECT date, {r('close * (SELECT arg_min(close, date) FROM a) / (SELECT arg_min(close, date) FROM b)', 4)} AS value FROM b")
def scaled_benchmark(spark, sf_dir):
    one, two = [fx.bars(spark, sf_dir).where(F.col("symbol") == s).select("date", F.col("close").alias("value")) for s in ("Brand#11", "Brand#4")]
    return readers.scaled_benchmark(one, two).withColumn("value", settled("value", 4))


@query(f"WITH {fx.BARS}, d AS (SELECT DISTINCT date FROM bars WHERE date < DATE '{DAY}' ORDER BY date DESC LIMIT 30) SELECT symbol, date, close FROM bars WHERE date >= DATE '{DAY}' OR date IN (SELECT date FROM d)")
def concat_warmup(spark, sf_dir):
    b = fx.bars(spark, sf_dir).select("symbol", "date", "close")
    return readers.concat_warmup(b.where(F.col("date") < DAY), b.where(F.col("date") >= DAY))


@query("SELECT event_id, event_type, value FROM events")
def read_jsonl(spark, sf_dir):
    path = work_folder(spark, "jsonl") + "/log"
    rows = fx.read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    half = F.expr("percentile_approx(value, 0.5)")
    mid = rows.agg(half.alias("m")).first()["m"] or 0.0
    readers.append_jsonl(rows.where(F.coalesce(F.col("value") <= mid, F.lit(True))), path)
    readers.append_jsonl(rows.where(F.col("value") > mid), path)
    return readers.read_jsonl(spark, path, rows.schema)


@query("SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders")
def read_csv(spark, sf_dir):
    path = work_folder(spark, "csv") + "/history"
    rows = fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    for part in (rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus != 'F'")):
        readers.append_csv(part, path)
    return readers.read_csv(spark, path, rows.schema)


# --- text functions -----------------------------------------------------------------------------------------------


@query("SELECT page_id, substr(list_aggregate(list_transform(string_split(replace(regexp_extract(regexp_replace(url, '[?#].*$|/+$', ''), '[^/]*$'), '-', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' '), 1, 300) AS title FROM pages")
def title_from_slug(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select("page_id", tx.title_from_slug(F.col("url")).alias("title"))


@query("SELECT event_id, CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS at FROM events")
def parse_iso_ts(spark, sf_dir):
    return fx.read(spark, sf_dir, "events").select("event_id", tx.parse_iso_ts(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("at"))
