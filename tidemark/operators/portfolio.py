"""Signals, trades, equity curve, metrics, factor legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import half_away
from tidemark.operators import joins


def signals(predictions: DataFrame, threshold: float = 0.5, cap: float = 0.10, floor: float = 0.005, fallback: float = 0.15) -> DataFrame:
    """z_score, signal, position_size and pred_close from pred_ret, vol_20d and close."""
    z = half_away(F.col("pred_ret") / F.greatest(F.coalesce(F.col("vol_20d"), F.lit(fallback)), F.lit(floor)), 6)
    df = predictions.withColumn("z_score", z)
    side = F.when(F.col("z_score") > threshold, "LONG").when(F.col("z_score") < -threshold, "SHORT").otherwise("FLAT")
    size = F.when(side == "FLAT", 0.0).otherwise(half_away(F.least(F.abs("z_score") / 2, F.lit(cap)), 4))
    return df.withColumns({"signal": side, "position_size": size, "pred_close": F.round(F.col("close") * F.exp("pred_ret"), 2)})


def top_signals(rows: DataFrame, n: int = 5) -> DataFrame:
    """n strongest LONG and SHORT a date and all FLAT; ties by symbol."""
    strength = F.when(F.col("signal") == "LONG", -F.col("z_score")).otherwise(F.col("z_score"))
    rank = F.row_number().over(Window.partitionBy("date", "signal").orderBy(strength, "symbol"))
    return rows.withColumn("_r", rank).where((F.col("signal") == "FLAT") | (F.col("_r") <= n)).drop("_r")


def round_trip_trades(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Entry at the close of the signal date, exit at the first later signal date on which the symbol has a price."""
    dates = rows.select("date").distinct()
    priced = bars.join(dates, "date", "left_semi").select("symbol", "date", "close")
    after = Window.partitionBy("symbol").orderBy("date")
    steps = priced.select("symbol", "date", F.col("close").alias("entry_price"), F.lead("date").over(after).alias("exit_date"), F.lead("close").over(after).alias("exit_price"))
    return rows.where("signal != 'FLAT'").select("symbol", "date", "signal", "position_size").join(steps, ["symbol", "date"]).withColumns({
        "actual_ret": half_away(F.log(F.col("exit_price") / F.col("entry_price")), 8),
        "status": F.when(F.col("exit_date").isNull(), "open").otherwise("closed")})


def trade_pnl(trades: DataFrame, capital: float = 1_000_000.0, cost_bps: float = 20.0) -> DataFrame:
    """Gross and net profit of closed trades; the whole round trip is charged at the exit."""
    alloc = F.lit(capital) * F.col("position_size")
    sign = F.when(F.col("signal") == "LONG", 1.0).otherwise(-1.0)
    return trades.where("status = 'closed'").withColumns({"pnl_gross": half_away(alloc * sign * F.col("actual_ret"), 4), "cost": half_away(alloc * cost_bps / 1e4, 4)}).withColumn(
        "pnl_net", half_away(F.col("pnl_gross") - F.col("cost"), 4))


def equity_curve(trades: DataFrame, capital: float = 1_000_000.0, cost_bps: float = 20.0) -> DataFrame:
    sign = F.when(F.col("signal") == "LONG", 1.0).otherwise(-1.0)
    daily = trades.where("status = 'closed'").groupBy(F.col("exit_date").alias("date")).agg(
        F.sum(F.col("position_size") * (sign * F.col("actual_ret") - cost_bps / 1e4)).alias("ret"), F.count("*").alias("n_trades"))
    # One row a date is left: a window without a partition stays small.
    growth = F.exp(F.sum(F.log(1 + F.col("ret"))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return daily.select("date", "n_trades", F.round("ret", 8).alias("daily_return"), F.round(capital * growth, 2).alias("portfolio_value"), F.round(growth - 1, 8).alias("cum_return"))


def sharpe(ret: Column) -> Column:
    return F.when((F.count(ret) >= 2) & (F.stddev_samp(ret) > 0), F.avg(ret) / F.stddev_samp(ret) * F.sqrt(F.lit(252.0))).otherwise(F.lit(0.0))


def sortino(ret: Column) -> Column:
    low = F.when(ret < 0, ret)
    return F.when(F.count(ret) < 2, 0.0).when(F.count(low) < 2, float("inf")).when(F.stddev_samp(low) > 0, F.avg(ret) / F.stddev_samp(low) * F.sqrt(F.lit(252.0))).otherwise(F.lit(0.0))


def forecast_metrics(pred: Column, actual: Column) -> dict[str, Column]:
    both = pred.isNotNull() & actual.isNotNull()
    p, a = F.when(both, pred), F.when(both, actual)
    enough = lambda x: F.when(F.count(p) >= 2, x)
    return {"mae": enough(F.avg(F.abs(p - a))), "rmse": enough(F.sqrt(F.avg((p - a) * (p - a)))),
            "hit_rate": enough(F.avg((F.signum(p) == F.signum(a)).cast("double"))), "ic": enough(F.corr(p, a))}


def rank_legs(scores: DataFrame, n: int = 5) -> DataFrame:
    """leg = long (top n), short (bottom n) or null per date; ties by symbol."""
    up = F.row_number().over(Window.partitionBy("date").orderBy(F.col("score").desc(), "symbol"))
    down = F.row_number().over(Window.partitionBy("date").orderBy("score", "symbol"))
    return scores.where("score is not null").withColumns({"_u": up, "_d": down}).withColumn(
        "leg", F.when(F.col("_u") <= n, "long").when(F.col("_d") <= n, "short")).drop("_u", "_d")


def calmar(annual: Column, max_drawdown: Column) -> Column:
    return F.when(max_drawdown != 0, annual / F.abs(max_drawdown)).otherwise(F.lit(0.0))


def annualised_return(total: Column, days: Column) -> Column:
    return F.when(days > 0, F.pow(1 + total, 252.0 / days) - 1).otherwise(F.lit(0.0))


def hit_rate(pnl: Column) -> Column:
    return F.coalesce(F.avg((pnl > 0).cast("double")), F.lit(0.0))


def win_loss(pnl: Column) -> Column:
    """Mean win by mean loss; 0 if there are no wins or no losses."""
    return F.coalesce(F.avg(F.when(pnl > 0, pnl)) / F.abs(F.avg(F.when(pnl < 0, pnl))), F.lit(0.0))


def portfolio_metrics(snapshots: DataFrame, trades: DataFrame, capital: float = 1_000_000.0, digits: dict[str, int] | None = None) -> DataFrame:
    """One row of twenty figures from snapshots (one a day: date, portfolio_value, daily_pnl, daily_return, transaction_costs, open_positions,
    longs, shorts) and trades (status, pnl_net); all 0 where there are no snapshots. Each figure is rounded once: to two digits (ratios and
    today's return to four), or to those that digits gives for it."""
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    top = F.max("portfolio_value").over(so_far)
    marked = snapshots.withColumn("_dd", (F.col("portfolio_value") - top) / top)
    latest = lambda c: F.max_by(c, "date").alias(f"_{c}")
    ret = F.col("daily_return")
    s = marked.agg(F.count("*").alias("trading_days"), *[latest(c) for c in ("portfolio_value", "daily_pnl", "daily_return", "open_positions", "longs", "shorts")],
                   F.when(F.count("*") > 1, F.min("_dd")).otherwise(0.0).alias("_mdd"), F.coalesce(F.stddev_samp(ret), F.lit(0.0)).alias("_vol"), sharpe(ret).alias("_sharpe"),
                   sortino(ret).alias("_sortino"), F.sum("transaction_costs").alias("_costs"))
    closed = trades.where("status = 'closed'").agg(F.count("*").alias("_closed"), hit_rate(F.col("pnl_net")).alias("_hit"), win_loss(F.col("pnl_net")).alias("_wl"))
    total = F.col("_portfolio_value") / capital - 1
    annual = annualised_return(total, F.col("trading_days"))
    fields = {"portfolio_value": (F.col("_portfolio_value"), 2), "initial_capital": (F.lit(float(capital)), 2), "cum_pnl": (F.col("_portfolio_value") - capital, 2),
              "today_pnl": (F.col("_daily_pnl"), 2), "today_return_pct": (F.col("_daily_return") * 100, 4), "total_return_pct": (total * 100, 2),
              "ann_return_pct": (annual * 100, 2), "ann_volatility_pct": (F.col("_vol") * F.sqrt(F.lit(252.0)) * 100, 2), "sharpe_ratio": (F.col("_sharpe"), 4),
              "sortino_ratio": (F.col("_sortino"), 4), "max_drawdown_pct": (F.col("_mdd") * 100, 2), "calmar_ratio": (calmar(annual, F.col("_mdd")), 4),
              "total_trades": (F.col("_closed"), 0), "hit_rate_pct": (F.col("_hit") * 100, 2), "win_loss_ratio": (F.col("_wl"), 2), "total_costs": (F.col("_costs"), 2),
              "open_positions": (F.col("_open_positions"), 0), "open_longs": (F.col("_longs"), 0), "open_shorts": (F.col("_shorts"), 0), "trading_days": (F.col("trading_days"), 0)}
    fields = {k: half_away(c.cast("double"), (digits or {}).get(k, d)) for k, (c, d) in fields.items()}
    return s.crossJoin(closed).select(*[F.when(F.col("trading_days") > 0, c).otherwise(0.0).alias(k) for k, c in fields.items()])


def mark_to_market(positions: DataFrame, prices: DataFrame, stale_days: int | None = None) -> DataFrame:
    """date, value: open positions (date, symbol, signal, entry_price, capital_allocated) at the date's close, at entry where there is no price.

    With stale_days the newest close up to so many days old stands in for a missing one before the entry price does."""
    worth = valued(positions, prices, stale_days)
    return worth.groupBy("date").agg(F.sum(F.col("capital_allocated") + F.col("gain")).alias("value"))


def valued(positions: DataFrame, prices: DataFrame, stale_days: int | None = None) -> DataFrame:
    """positions plus price (null where there is none) and gain, what the position has won or lost at it."""
    bars = prices.select("symbol", "date", "close")
    if stale_days is not None:
        asked = positions.select("symbol", "date").distinct()
        bars = joins.asof_backward(asked, bars.dropna(), ["close"], stale_days).select("symbol", "date", "close")
    sign = F.when(F.col("signal") == "LONG", 1.0).otherwise(-1.0)
    priced = positions.join(bars.withColumnRenamed("close", "price"), ["symbol", "date"], "left")
    gain = F.when(F.col("entry_price") > 0, F.log(F.coalesce("price", "entry_price") / F.col("entry_price"))).otherwise(0.0)
    return priced.withColumn("gain", F.col("capital_allocated") * sign * gain)


def open_positions(trades: DataFrame, dates: DataFrame) -> DataFrame:
    """The trades (symbol, date of entry, exit_date or null, ..) on every date on which they are open: date, entry_date and their other columns.

    A trade is open from its entry date to the date before its exit, without an exit to the last date. Dates are numbered without gaps
    (one small row each), so a trade becomes a span of numbers and no range join is needed; an entry or exit between two
    dates counts from the next one. A trade makes as many rows as it is open for dates, which is the result."""
    w = Window.orderBy("date")
    calendar = dates.select("date").distinct().where("date is not null").withColumn("_i", F.row_number().over(w))
    span = calendar.agg(F.min("date").alias("_a"), F.max("date").alias("_b"), F.max("_i").alias("_n"))
    days = span.select(F.explode(F.sequence("_a", "_b")).alias("_day")).join(calendar, F.col("_day") == F.col("date"), "left").select(
        "_day", F.first("_i", ignorenulls=True).over(Window.orderBy("_day").rowsBetween(0, Window.unboundedFollowing)).alias("_at"))  # one row a calendar day
    clipped = lambda c: F.greatest(F.col(c), F.col("_a"))
    begun = trades.withColumnRenamed("date", "entry_date").crossJoin(F.broadcast(span)).where("entry_date <= _b")
    begun = begun.withColumns({"_from": clipped("entry_date"), "_to": F.when(F.col("exit_date") <= F.col("_b"), clipped("exit_date"))})
    begun = begun.join(F.broadcast(days.select(F.col("_day").alias("_from"), F.col("_at").alias("_first"))), "_from")
    begun = begun.join(F.broadcast(days.select(F.col("_day").alias("_to"), F.col("_at").alias("_end"))), "_to", "left")
    last = F.coalesce(F.col("_end") - 1, F.col("_n"))
    held = begun.where(F.col("_first") <= last).withColumn("_i", F.explode(F.sequence("_first", last)))
    kept = [c for c in trades.columns if c != "date"]
    return held.join(F.broadcast(calendar), "_i").select("date", "entry_date", *kept)


def daily_valuation(trades: DataFrame, prices: DataFrame, dates: DataFrame, capital: float = 1_000_000.0, cost_bps: float = 20.0, stale_days: int | None = None) -> DataFrame:
    """One row a date: portfolio_value (capital, what closed trades have brought up to the date, and what open ones are worth more or less than they cost),
    realised, unrealised, daily_return, cum_return, open_positions, longs, shorts. trades: symbol, date, signal, position_size, entry_price, exit_date, actual_ret, status."""
    marked = trades.withColumn("capital_allocated", F.lit(capital) * F.col("position_size"))
    worth = valued(open_positions(marked, dates), prices, stale_days).groupBy("date").agg(
        F.sum("gain").alias("unrealised"), F.count("*").alias("open_positions"), F.count_if(F.col("signal") == "LONG").alias("longs"), F.count_if(F.col("signal") == "SHORT").alias("shorts"))
    closed = trade_pnl(trades, capital, cost_bps).groupBy(F.col("exit_date").alias("date")).agg(F.sum("pnl_net").alias("_won"))
    every = dates.select("date").distinct().where("date is not null").withColumn("_shown", F.lit(True))
    w = Window.orderBy("date")  # one row a date
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0.0)
    rows = every.join(closed, "date", "full").join(worth, "date", "left")  # a trade may close on a date that isn't shown
    rows = rows.withColumns({"realised": F.sum(F.coalesce("_won", none)).over(so_far), "unrealised": F.coalesce("unrealised", none)}).where("_shown")
    rows = rows.withColumn("_v", F.lit(capital) + F.col("realised") + F.col("unrealised"))
    before = F.coalesce(F.lag("_v").over(w), F.lit(capital))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("open_positions", "longs", "shorts")]
    return rows.select("date", F.round("_v", 2).alias("portfolio_value"), F.round("realised", 2).alias("realised"), F.round("unrealised", 2).alias("unrealised"),
                       F.round(F.when(before > 0, F.col("_v") / before - 1).otherwise(0.0), 8).alias("daily_return"), F.round(F.col("_v") / capital - 1, 8).alias("cum_return"), *counts)


def daily_close_out(open_trades: DataFrame, signals: DataFrame, prices: DataFrame, day: str, value: float, cash: float, cost_bps: float = 20.0, capital: float = 1_000_000.0,
                    least: float = 100.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(closed, opened, snapshot) of a day: open trades with a price that day are closed, the day's signals are opened in order of |z_score|
    as far as cash goes, and one snapshot is made. A caller that holds a snapshot of the day already skips it.

    What is left of cash before a signal is cash less all larger ones' wishes: past the end of the cash that is negative, so no loop is needed."""
    at = F.lit(day).cast("date")
    price = prices.where(F.col("date") == at).select("symbol", F.col("close").alias("price"))
    sign = F.when(F.col("signal") == "LONG", 1.0).otherwise(-1.0)
    ret = F.when(F.col("entry_price") > 0, F.log(F.col("price") / F.col("entry_price"))).otherwise(0.0)
    cost = F.col("capital_allocated") * cost_bps / 1e4
    closed = open_trades.join(price, "symbol").select("symbol", "signal", "entry_price", "capital_allocated", at.alias("exit_date"), F.round("price", 4).alias("exit_price"),
                                                      F.round(ret, 8).alias("actual_ret"), cost.alias("cost"), (F.col("capital_allocated") * sign * ret - cost).alias("pnl_net"))
    total = closed.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in {"pnl": F.col("pnl_net"), "costs": F.col("cost"), "back": F.col("capital_allocated")}.items()],
                       F.count("*").alias("n_closed"))
    wish = (value + F.col("pnl")) * F.col("position_size")
    order = Window.partitionBy("date").orderBy(F.desc(F.abs("z_score")), "symbol").rowsBetween(Window.unboundedPreceding, -1)
    wanted = signals.where((F.col("date") == at) & (F.col("signal") != "FLAT")).join(price.where("price > 0"), "symbol").crossJoin(F.broadcast(total)).withColumn("wish", wish).where(
        F.col("wish") >= least)
    left = cash + F.col("back") + F.col("pnl") - F.coalesce(F.sum("wish").over(order), F.lit(0.0))
    opened = wanted.withColumn("capital_allocated", F.least("wish", left)).where(F.col("capital_allocated") >= least).select(
        "symbol", "date", "signal", F.round("price", 4).alias("entry_price"), "position_size", "capital_allocated", "z_score")
    new = opened.agg(F.coalesce(F.sum("capital_allocated"), F.lit(0.0)).alias("used"), F.count_if(F.col("signal") == "LONG").alias("longs"), F.count_if(F.col("signal") == "SHORT").alias("shorts"))
    kept = open_trades.join(price, "symbol", "left_anti").agg(F.count("*").alias("kept"))
    worth = value + F.col("pnl")
    snapshot = total.crossJoin(new).crossJoin(kept).select(
        at.alias("date"), F.round(worth, 2).alias("portfolio_value"), F.round(cash + F.col("back") + F.col("pnl") - F.col("used"), 2).alias("cash"), F.round("pnl", 2).alias("daily_pnl"),
        F.round(worth / value - 1, 8).alias("daily_return"), F.round(worth / capital - 1, 8).alias("cum_return"), (F.col("kept") + F.col("longs") + F.col("shorts")).alias("open_positions"),
        "longs", "shorts", F.round(F.col("back") + F.col("used"), 2).alias("daily_turnover"), F.round("costs", 2).alias("transaction_costs"))
    return closed, opened, snapshot


def rebalance_dates(dates: DataFrame, history: int) -> DataFrame:
    """idx, date, held: every date with its number and the month's first date that last chose members, null before `history` dates are past."""
    w = Window.orderBy("date")  # one row a date
    numbered = dates.select("date").distinct().withColumn("idx", F.row_number().over(w) - 1)
    first = F.coalesce(F.trunc("date", "month") != F.trunc(F.lag("date").over(w), "month"), F.lit(True)) & (F.col("idx") >= history)
    return numbered.withColumn("held", F.last(F.when(first, F.col("date")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def hold_until_rebalance(scores: DataFrame, dates: DataFrame, n: int = 5) -> DataFrame:
    """date, symbol, leg on every date: members ranked by the scores (symbol, date) of the date that is held; dates: from rebalance_dates."""
    held = dates.where("held is not null").select("date", "held")
    chosen = rank_legs(scores.join(F.broadcast(held.select(F.col("held").alias("date")).distinct()), "date", "left_semi"), n).where("leg is not null")  # a month's date each
    return held.join(chosen.select(F.col("date").alias("held"), "symbol", "leg"), "held").select("date", "symbol", "leg")


def momentum_scores(returns: DataFrame, dates: DataFrame, days: int = 63) -> DataFrame:
    """symbol, date, score on the dates that choose members: the sum of the symbol's returns over the `days` market dates before; 0 for none."""
    choosing = dates.where("held = date").select("date", "idx")  # one a month
    wanted = returns.select("symbol").distinct().crossJoin(F.broadcast(choosing)).select("symbol", "idx", "date", F.lit(None).cast("double").alias("ret"), F.lit(True).alias("asked"))
    known = returns.join(F.broadcast(dates.select("date", "idx")), "date").select("symbol", "idx", "date", "ret", F.lit(False).alias("asked"))
    before = Window.partitionBy("symbol").orderBy("idx").rangeBetween(-days, -1)
    return known.unionByName(wanted).withColumn("score", F.round(F.coalesce(F.sum("ret").over(before), F.lit(0.0)), 7)).where("asked").select("symbol", "date", "score")


def value_scores(bars: DataFrame, dates: DataFrame, days: int = 252) -> DataFrame:
    """symbol, date, score on the dates that choose members: less the close by the highest of the `days` market dates before, so cheap ones rank first."""
    before = Window.partitionBy("symbol").orderBy("idx").rangeBetween(-days, -1)
    rows = bars.join(F.broadcast(dates.select("date", "idx", "held")), "date").withColumn("score", F.round(-F.col("close") / F.max("close").over(before), 7))
    return rows.where("held = date and score is not null").select("symbol", "date", "score")


def long_short_factor(legs: DataFrame, returns: DataFrame, dates: DataFrame) -> DataFrame:
    """date, ret: mean return of the long members less that of the short ones on every date; 0 before members are chosen and for legs without prices."""
    side = lambda leg: F.coalesce(F.avg(F.when(F.col("leg") == leg, F.col("ret"))), F.lit(0.0))
    daily = legs.join(returns.select("symbol", "date", "ret"), ["symbol", "date"]).groupBy("date").agg((side("long") - side("short")).alias("ret"))
    return dates.select("date").join(daily, "date", "left").select("date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
