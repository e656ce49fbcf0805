"""Feature assembly and the joins around it: tagged news, prices by key, aligned series, gap plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.operators import joins

SENTIMENT = ("sent_pos", "sent_neg", "sent_neu", "sent_spread", "news_count")
TECHNICAL = ("rsi_14", "ma_20", "ma_50", "price_to_ma20", "vol_20d", "rel_volume", "bb_position", "lag_ret_1d", "lag_ret_2d")
DAYS = ("dow_mon", "dow_tue", "dow_wed", "dow_thu", "dow_fri")
#: The columns a model reads: all but the two averages that are kept as levels.
MODEL = (*SENTIMENT, *(c for c in TECHNICAL if c not in ("ma_20", "ma_50")), *DAYS)


def tagged_news(tags: DataFrame, articles: DataFrame, first: str | None = None, final: str | None = None, day: str = "trading_date") -> DataFrame:
    """The articles of every tag (article_id, symbol), on days first to final."""
    rows = articles
    if first is not None:
        rows = rows.where(F.col(day) >= F.lit(first).cast("date"))
    if final is not None:
        rows = rows.where(F.col(day) <= F.lit(final).cast("date"))
    return tags.join(rows, "article_id")


def articles_by_symbol(tagged: DataFrame, day: str | None = None) -> DataFrame:
    """symbol (and day), n: how many different articles."""
    keys = ["symbol"] if day is None else ["symbol", day]
    return tagged.groupBy(*keys).agg(F.countDistinct("article_id").alias("n"))


def features_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left with the columns of right for the same symbol and date, nulls where there is none."""
    return left.join(right, ["symbol", "date"], "left")


def feature_matrix(grid: DataFrame, sentiment: DataFrame, technical: DataFrame, existing: DataFrame | None = None, max_days: int = 5, skip_neutral: bool = False) -> DataFrame:
    """One row for each (symbol, date) of grid that existing lacks: sentiment of the day or of up to max_days before, else neutral; indicators
    of the day; news_count as log(1 + n); weekday flags; target_ret_1d null until known.

    One shuffle on symbol for the as-of join, one on (symbol, date) for the rest. skip_neutral passes over days without news."""
    days = sentiment.select("symbol", F.col("trading_date").alias("date"), *SENTIMENT)
    if skip_neutral:
        days = days.where("news_count > 0")
    wanted = grid.select("symbol", "date").distinct()
    if existing is not None:
        wanted = joins.only_missing(wanted, existing, ["symbol", "date"])
    filled = joins.asof_backward(wanted, days, list(SENTIMENT), max_days).drop("source_date")
    neutral = {"sent_pos": 1 / 3, "sent_neg": 1 / 3, "sent_neu": 1 / 3, "sent_spread": 0.0}
    cells = [F.coalesce(c, F.lit(v)).alias(c) for c, v in neutral.items()]
    scaled = F.log1p(F.coalesce("news_count", F.lit(0)).cast("double")).alias("news_count")
    out = features_left_join(filled.select("symbol", "date", *cells, scaled), technical.select("symbol", "date", *TECHNICAL))
    return out.select("*", *[c.alias(k) for k, c in tx.dow_one_hot(F.col("date")).items()], F.lit(None).cast("double").alias("target_ret_1d"))


def labelled_rows(features: DataFrame, columns: tuple[str, ...] = MODEL, label: str = "target_ret_1d") -> DataFrame:
    """symbol, date, the model's columns and the label, where the label is known."""
    return features.where(F.col(label).isNotNull()).select("symbol", "date", *columns, label)


def wide_prices_to_bars(quotes: DataFrame, at: str, columns: dict[tuple[str, str], str]) -> DataFrame:
    """symbol, date, open, high, low, close, volume from one wide row a time; columns maps (symbol, field) to its column.

    Rows without a close go, a missing volume counts as 0, prices have 4 digits. No shuffle: each wide row gives its own bars."""
    symbols = sorted({s for s, _ in columns})
    price = lambda s, f: F.round(F.col(columns[s, f]).cast("double"), 4) if (s, f) in columns else F.lit(None).cast("double")
    volume = lambda s: F.coalesce(F.col(columns[s, "volume"]), F.lit(0)).cast("long") if (s, "volume") in columns else F.lit(0).cast("long")
    cells = [F.struct(F.lit(s).alias("symbol"), *[price(s, f).alias(f) for f in ("open", "high", "low", "close")], volume(s).alias("volume")) for s in symbols]
    long = quotes.select(F.to_date(at).alias("date"), F.explode(F.array(*cells)).alias("b"))
    return long.select("b.symbol", "date", "b.open", "b.high", "b.low", "b.close", "b.volume").where("close is not null")


def price_lookup(rows: DataFrame, bars: DataFrame, date: str = "date", into: str = "price") -> DataFrame:
    """rows plus the close of their symbol on exactly that date, null if there is none."""
    return rows.join(bars.select("symbol", F.col("date").alias(date), F.col("close").alias(into)), ["symbol", date], "left")


def align_series(series: dict[str, DataFrame], date: str = "date") -> DataFrame:
    """date and one column for each of several (date, ret) tables, on the dates all have, without nulls."""
    named = [s.select(date, F.col("ret").alias(k)) for k, s in series.items()]
    return reduce(lambda a, b: a.join(b, date), named).dropna()


def reindex_fill(left: DataFrame, other: DataFrame, columns: list[str], date: str = "date", value: float = 0.0) -> DataFrame:
    """left's dates with other's columns; what other lacks is value."""
    return left.join(other.select(date, *columns), date, "left").fillna(value, subset=columns)


def backfill_plan(sources: DataFrame, first: str, final: str, done: DataFrame) -> DataFrame:
    """source, week_start, week_end, key: the seven-day slices from first to final for each source, but for keys (`source|YYYY-Www`) that done holds."""
    start = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(final).cast("date"), F.expr("INTERVAL 7 DAYS")))
    weeks = sources.select("source").distinct().select("source", start.alias("week_start"))
    key = F.concat("source", F.lit("|"), F.extract(F.lit("YEAROFWEEK"), F.col("week_start")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("week_start").cast("string"), 2, "0"))
    plan = weeks.select("source", "week_start", F.least(F.date_add("week_start", 6), F.lit(final).cast("date")).alias("week_end"), key.alias("key"))
    return plan.join(done.select("key").distinct(), "key", "left_anti").select("source", "week_start", "week_end", "key")


def latest_bar_join(bars: DataFrame, indicators: DataFrame, columns: list[str], day: str) -> DataFrame:
    """symbol, date, close and indicator columns at each symbol's newest bar up to `day`; nulls where it has no indicators."""
    newest = bars.where(F.col("date") <= F.lit(day).cast("date")).groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    return features_left_join(newest, indicators.select("symbol", "date", *columns))


def run_audit(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """The run log after some runs (run_id, finished_at, status, error_msg and counters) have ended; runs not yet known are passed over."""
    columns = [c for c in finished.columns if c != "run_id"]
    once = finished.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("finished_at")))).where("_n = 1").drop("_n")
    joined = runs.join(once.select("run_id", *[F.col(c).alias(f"_new_{c}") for c in columns]), "run_id", "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in runs.columns])


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
