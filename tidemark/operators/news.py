"""News items: feed entries, links, sentiment, near-duplicate titles."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.operators.lineage import BROADCAST_ROWS, bounded_broadcast, checkpointed

#: Fixed word lists of the default scorer.
POSITIVE = ("thing", "attion", "erble", "gut", "bien")
NEGATIVE = ("thble", "ertion", "ering", "schlecht", "mal")


def normalise_entries(entries: DataFrame, days: tuple[str, str] | None = None) -> DataFrame:
    """article_id, source, title, summary, link, published_at of entries with a link and a title of 8 characters or more.

    Null titles and links count as empty, so such entries go; a null publisher is `google_news`. With days (first, last) only entries
    published on one of them stay, and those without a time go."""
    if days is not None:
        entries = entries.where(F.to_date("published_at").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))
    title, link = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("link", F.lit("")))
    kept = entries.where((link != "") & (F.length(title) >= 8))
    return kept.select(F.sha1(F.concat(F.lit("gnews|"), link)).alias("article_id"),
                       F.concat(F.lit("gnews_"), tx.slug(F.coalesce("publisher", F.lit("google_news")))).alias("source"),
                       F.substring(title, 1, 500).alias("title"),
                       F.substring(F.trim(tx.strip_tags(F.coalesce("summary", F.lit("")))), 1, 1500).alias("summary"), link.alias("link"), "published_at")


def extract_links(pages: DataFrame, looks_like: str = "^https?://") -> DataFrame:
    """page_id, link, pos: absolute links that match looks_like, the first of equal ones in a page; pos counts anchors from 0."""
    origin = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    found = pages.select("page_id", origin.alias("origin"), F.posexplode(hrefs).alias("pos", "href"))
    href = F.trim("href")
    link = (F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href))
            .when(href.startswith("/"), F.concat("origin", href)).otherwise(F.concat("origin", F.lit("/"), href)))
    return found.select("page_id", link.alias("link"), "pos").where(F.col("link").rlike(looks_like)).groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


def score_text(text: Column, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """Struct pos, neg, neu: softmax of the number of positive words, that of negative words, and 1."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(*known))).cast("double")
    p, n = hits(positive), hits(negative)
    top = F.greatest(p, n, F.lit(1.0))
    parts = [F.exp(x - top) for x in (p, n, F.lit(1.0))]
    total = parts[0] + parts[1] + parts[2]
    return F.struct(*[(x / total).alias(k) for x, k in zip(parts, ("pos", "neg", "neu"))])


def sentiment_daily(items: DataFrame, limit: int = 32, text: str = "text", scorer: Callable[[Column], Column] = score_text) -> DataFrame:
    """Mean scores of the latest `limit` items of each (symbol, trading_date), with counts.

    scorer makes a struct pos, neg, neu of the text: an expression, or a model by scoring.score_with. items: symbol, trading_date, article_id, published_at, text. Only the items that count are scored; all are counted,
    with partial sums before the shuffle. The time and id of each group's last item that counts are found without texts, so only texts that count are sorted and shuffled."""
    keys = ["symbol", "trading_date"]
    known = items.where("symbol is not null and trading_date is not null")
    at = F.struct("published_at", "article_id")
    ordered = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_at")))
    last = checkpointed(known.select(*keys, at.alias("_at")).withColumn("_n", ordered).where(F.col("_n") == limit).select(*keys, F.col("_at").alias("_last")))
    near = known.join(bounded_broadcast(last), keys, "left").where(F.col("_last").isNull() | (at >= F.col("_last")))
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("published_at"), F.desc("article_id")))
    used = near.withColumn("_n", latest).where(F.col("_n") <= limit).withColumn("_s", scorer(F.col(text)))
    means = used.groupBy(*keys).agg(*[F.round(F.avg(f"_s.{k}"), 6).alias(f"sent_{k}") for k in ("pos", "neg", "neu")],
                                    F.round(F.avg("_s.pos") - F.avg("_s.neg"), 6).alias("sent_spread"), F.count("*").alias("articles_used"))
    return means.join(known.groupBy(*keys).agg(F.count("*").alias("news_count")), keys)


def fill_neutral(daily: DataFrame, grid: DataFrame) -> DataFrame:
    """daily plus a neutral row for every (symbol, trading_date) of grid that it lacks."""
    third = F.round(F.lit(1 / 3), 6)
    lacking = grid.select("symbol", "trading_date").distinct().join(daily, ["symbol", "trading_date"], "left_anti")
    neutral = lacking.select("symbol", "trading_date", third.alias("sent_pos"), third.alias("sent_neg"), third.alias("sent_neu"), F.lit(0.0).alias("sent_spread"),
                             F.lit(0).cast("long").alias("articles_used"), F.lit(0).cast("long").alias("news_count"))
    return daily.unionByName(neutral)


def distinct_titles(items: DataFrame) -> DataFrame:
    """low (lower-cased title), first (published_at, article_id of its earliest item), n; empty titles go."""
    low = F.lower("title")
    return items.where(F.col("title") != "").groupBy(low.alias("low")).agg(F.min(F.struct("published_at", "article_id")).alias("first"), F.count("*").alias("n"))


#: Numbers of parts above this are rounded up to a grid that grows by GRID, so that a title of any size is cut in a few ways only.
EXACT_PARTS, GRID = 8, 1.15
#: Words of 64 bits of a title's sketch, and of the shorter one that goes with the keys if titles are too many to broadcast their sketches.
SKETCH, SHORT = 4, 2
#: Titles whose sketches are broadcast.
MOST_SKETCHES = BROADCAST_ROWS


def _ways(n: int, threshold: float) -> list[int]:
    """Numbers of parts into which a set of n grams is cut: for each size of the other set that is near enough, so many that one
    part at least differs by one gram or none. Two sets near enough always share a number."""
    found, grid = set(), 1
    for total in range(n + math.ceil(n * threshold - 1e-9), n + math.floor(n / threshold + 1e-9) + 1):
        needed = int(total * (1 - threshold) / (1 + threshold) + 1e-9) // 2 + 1
        while grid < needed:
            grid = grid + 1 if grid < EXACT_PARTS else math.ceil(grid * GRID)
        found.add(grid)
    return sorted(found)


def _sketch(hashes: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """A row a set: for each of 64 * words bits whether an odd number of its grams falls on it."""
    bits, bit = np.zeros((len(sizes), words), np.uint64), hashes % np.uint64(64 * words)
    np.bitwise_xor.at(bits, (np.repeat(np.arange(len(sizes)), sizes), (bit // np.uint64(64)).astype(np.int64)), np.uint64(1) << (bit % np.uint64(64)))
    return bits


def _sketch_columns(bits: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(bits[:, i]).view(np.int64)) for i in range(bits.shape[1])]


def _part_keys(threshold: float, words: int):
    """From (no, grams as hashes): the hash of each part of each way, as it is (whole) and without each of its grams, with the set's sketch of so many words."""

    def run(batches):
        ways = lru_cache(100_000)(lambda n: np.array(_ways(n, threshold), dtype=np.int64))
        for batch in batches:
            lists = batch.column(1)
            hashes, sizes = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            starts, numbers, short = np.cumsum(sizes) - sizes, batch.column(0).to_numpy(), _sketch(hashes, sizes, words) if words else np.zeros((len(sizes), 0), np.uint64)
            cuts = [ways(int(n)) for n in sizes]
            row, m = np.repeat(np.arange(len(sizes)), [len(c) for c in cuts]), np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
            for some in np.array_split(np.arange(len(row)), int((sizes[row] + m).sum()) // 1_000_000 + 1):  # bounds the memory of a task
                r, k = row[some], m[some]
                n, first = sizes[r], np.cumsum(k) - k
                each = np.repeat(np.arange(len(r)), n)
                h = hashes[np.repeat(starts[r] - (np.cumsum(n) - n), n) + np.arange(len(each))]
                part = first[each] + ((h >> np.uint64(32)) % k[each].astype(np.uint64)).astype(np.int64)
                owner = np.repeat(np.arange(len(r)), k)
                place = (np.arange(len(owner)) - first[owner]).astype(np.uint64)
                whole = (k[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (place * np.uint64(0xC2B2AE3D27D4EB4F))
                np.add.at(whole, part, h)
                less, at = whole[part] - h, np.concatenate([r[owner], r[each]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([whole, less]).view(np.int64)), pa.array(numbers[at]), pa.array(sizes[at].astype(np.int32)),
                                                  pa.array(np.arange(len(at)) < len(owner)), *_sketch_columns(short[at])], names=["key", "no", "n", "whole", *[f"s{i}" for i in range(words)]])

    return run


def _sketches(batches):
    """From (no, grams as hashes): the sketch of each set."""
    for batch in batches:
        lists = batch.column(1)
        bits = _sketch(lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy()), SKETCH)
        yield pa.RecordBatch.from_arrays([batch.column(0), *_sketch_columns(bits)], names=["no", *[f"s{i}" for i in range(SKETCH)]])


def _met(titles: DataFrame, threshold: float, words: int) -> DataFrame:
    """(x, y, nx, ny) where hashed sets, titles(no, h), meet on a part and are near enough by their sizes and, if keys carry sketches of
    so many words, by these. A pair stands as often as it met."""
    keys = titles.mapInArrow(_part_keys(threshold, words), ", ".join(["key long, no long, n int, whole boolean", *[f"s{i} long" for i in range(words)]]))
    sized = F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9
    once = (F.col("x") < F.col("y")) | (~F.col("whole") & (F.col("x") != F.col("y")))
    met = _of(keys.where("whole").drop("whole"), "x").join(_of(keys, "y"), "key").where(sized & once)
    return (met.where(_alike(threshold, words)) if words else met).select("x", "y", "nx", "ny")


def _of(rows: DataFrame, c: str) -> DataFrame:
    return rows.select(*[F.col(o).alias(c if o == "no" else o if o in ("key", "whole") else f"{o}{c}") for o in rows.columns])


def _alike(threshold: float, words: int) -> Column:
    """Whether the sketches x and y differ in no more bits than sets near enough differ in grams."""
    apart = sum((F.bit_count(F.col(f"s{i}x").bitwiseXOR(F.col(f"s{i}y"))) for i in range(words)), F.lit(0))
    return apart <= (F.col("nx") + F.col("ny")) * ((1 - threshold) / (1 + threshold)) + 1e-9


def near_dup_pairs(titles: DataFrame, threshold: float = 0.75, k: int = 3) -> DataFrame:
    """Pairs (a, b, sim) of distinct titles, earlier first, whose k-gram sets have a Jaccard similarity of threshold or more.

    titles: low, first. Sets that near differ by a bounded number of grams. Grams are dealt by hash into more than half as many parts, so that
    one part at least is the same in both or lacks one gram in one of them: titles meet on a part's hash, whole or less one gram. Where they
    meet they are judged by sizes and sketches, whose bits can't differ more often than the sets do, before rows are shuffled: sketches are
    broadcast for MOST_SKETCHES titles at most, beyond that the keys carry short ones into the join. The rest is confirmed on whole sets. No
    step leaves out a pair that is near enough. titles are numbered and written once."""
    known = checkpointed(titles.select(F.monotonically_increasing_id().alias("no"), F.col("first.article_id").alias("id"), F.col("first.published_at").alias("at"), "low"))
    grams = tx.char_shingles(F.col("low"), k)
    hashed = known.select("no", F.transform(grams, lambda g: F.xxhash64(g)).alias("h"))
    few = known.count() <= MOST_SKETCHES
    sketches = hashed.mapInArrow(_sketches, "no long, " + ", ".join(f"s{i} long" for i in range(SKETCH)))
    sketches = F.broadcast(sketches) if few else sketches
    met = _met(hashed, threshold, 0 if few else SHORT)
    met = met.join(_of(sketches, "x"), "x").join(_of(sketches, "y"), "y").where(_alike(threshold, SKETCH))
    met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    sets = known.select("no", "id", "at", grams.alias("g"))
    common = F.size(F.array_intersect("gx", "gy"))
    sim = common / (F.size("gx") + F.size("gy") - common)
    both = met.join(_of(sets, "x"), "x").join(_of(sets, "y"), "y").withColumn("sim", sim).where(F.col("sim") >= threshold)
    ahead = F.struct("atx", "idx") < F.struct("aty", "idy")
    return both.select(F.when(ahead, F.col("idx")).otherwise(F.col("idy")).alias("a"), F.when(ahead, F.col("idy")).otherwise(F.col("idx")).alias("b"), "sim")


def near_dedup(items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The items that remain if, by publication, each is dropped that is like one already kept.

    Equal titles are one, so only the first of them can stay. Rounds: a title without an undecided or kept earlier
    neighbour stays, a title with a kept one goes; each round decides at least the earliest undecided one of every
    group and is checkpointed. Items without a title go."""
    titles = distinct_titles(items)
    edges = checkpointed(near_dup_pairs(titles, threshold).select("a", "b"))
    ids = titles.select(F.col("first.article_id").alias("id"))
    open_, dropped = edges, None
    while open_.head(1):
        later = open_.select(F.col("b").alias("a")).distinct()
        keep = open_.join(later, "a", "left_anti").select("a").distinct()
        gone = checkpointed(open_.join(keep, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = open_.join(keep, "a", "left_anti")
        rest = rest.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti")
        open_ = checkpointed(rest.select("a", "b"))
    kept = ids if dropped is None else ids.join(dropped, "id", "left_anti")
    return items.join(kept.withColumnRenamed("id", "article_id"), "article_id", "left_semi")
