"""Market tables derived from the given ones, each with the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import half_away
from tidemark.operators import timeseries as ts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, symbol: str = "p_brand") -> DataFrame:
    """Daily bars: symbol is a part's brand, days are ship dates."""
    x = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col(symbol).alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_quantity",
        (100 + (F.col("l_extendedprice") % 1000) / 80).alias("px"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("k"))
    return x.groupBy("symbol", "date").agg(F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
                                           F.max_by("px", "k").alias("close"), F.sum("l_quantity").cast("long").alias("volume"))


BARS = """x AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_quantity, 100 + (l_extendedprice % 1000) / 80 AS px,
 (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT symbol, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM x GROUP BY 1, 2)"""
RETS = BARS + """, rets AS (SELECT *, round(coalesce(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)), 0.0), 8) AS log_return_1d FROM bars)"""
HOLIDAYS = ("01-01", "01-26", "08-15", "10-02", "12-25")


def sessions(spark: SparkSession) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))).alias("session_date"))
    return days.where((F.weekday("session_date") < 5) & ~F.date_format("session_date", "MM-dd").isin(*HOLIDAYS))


SESSIONS = """sessions AS (SELECT CAST(d AS DATE) AS session_date FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(d)
 WHERE isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ('01-01', '01-26', '08-15', '10-02', '12-25'))"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("text", r"^[^.\n]*", 0)
    minutes = (F.col("doc_id") * 7919) % 259200
    return read(spark, sf_dir, "documents").where("text is not null").select(
        F.sha1(F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("article_id"), "source", title.alias("title"),
        F.substr(F.col("text"), F.length(title) + 1, F.length("text")).alias("summary"),
        F.timestamp_seconds(F.lit(883612800) + minutes * 60).alias("published_at"), "doc_id")


ARTICLES = r"""articles AS (SELECT sha1(concat_ws('|', source, CAST(doc_id AS VARCHAR))) AS article_id, source, regexp_extract(text, '^[^.\n]*') AS title,
 substr(text, length(regexp_extract(text, '^[^.\n]*')) + 1) AS summary, TIMESTAMP '1998-01-01 00:00:00' + to_minutes(CAST((doc_id * 7919) % 259200 AS INTEGER)) AS published_at,
 doc_id FROM documents WHERE text IS NOT NULL)"""
ALIASES = [("thble", "Brand#1"), ("thing", "Brand#2"), ("thtion", "Brand#3"), ("attion", "Brand#4"), ("erble", "Brand#5"), ("ertion", "Brand#6"),
           ("ering", "Brand#7"), ("thanea", "Brand#8"), ("the thing", "Brand#1"), ("ertion of", "Brand#2"), ("eron", "Brand#8")]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed linear rule on indicators in place of a model, with exact oracles."""
    f = ts.with_returns(bars(spark, sf_dir)).select("symbol", "date", "close", ts.realised_vol().alias("vol_20d"),
                                                    ts.lag_return(1).alias("a"), ts.lag_return(2).alias("b"), ts.bollinger_position().alias("bb"))
    return f.where("a is not null and b is not null and bb is not null").select(
        "symbol", "date", "close", "vol_20d", half_away(0.5 * F.col("a") - 0.25 * F.col("b") + 0.05 * (F.col("bb") - 0.5), 8).alias("pred_ret"))


_W = "PARTITION BY symbol ORDER BY date"
INDICATORS = RETS + f""", ind AS (SELECT *,
 CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS ma_20, CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS ma_50,
 CASE WHEN count(log_return_1d) OVER w20 = 20 THEN stddev_samp(log_return_1d) OVER w20 * sqrt(252.0) END AS vol_20d,
 CASE WHEN count(volume) OVER p20 = 20 AND avg(volume) OVER p20 > 0 THEN volume / avg(volume) OVER p20 END AS rel_volume,
 CASE WHEN count(close) OVER w20 = 20 AND stddev_samp(close) OVER w20 >= 1e-10 THEN round(greatest(least((close - (avg(close) OVER w20 - 2 * stddev_samp(close) OVER w20)) / (4 * stddev_samp(close) OVER w20), 1.5), -0.5), 6) END AS bb_position,
 lag(log_return_1d, 1) OVER w AS lag_ret_1d, lag(log_return_1d, 2) OVER w AS lag_ret_2d,
 count(*) OVER w120 AS recent, list(close) OVER w120 AS closes
 FROM rets WINDOW w AS ({_W}), w20 AS ({_W} ROWS 19 PRECEDING), w50 AS ({_W} ROWS 49 PRECEDING), p20 AS ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
 w120 AS ({_W} RANGE BETWEEN INTERVAL 120 DAYS PRECEDING AND CURRENT ROW))"""
PREDICTIONS = INDICATORS + """, predictions AS (SELECT symbol, date, close, vol_20d, round(0.5 * lag_ret_1d - 0.25 * lag_ret_2d + 0.05 * (bb_position - 0.5), 8) AS pred_ret
 FROM ind WHERE lag_ret_1d IS NOT NULL AND lag_ret_2d IS NOT NULL AND bb_position IS NOT NULL)"""
