"""Column functions on text, time and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_id(*parts) -> Column:
    """SHA-1 of the parts joined by `|`; a null part counts as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]))


def clean_text(text: Column, limit: int = 500) -> Column:
    """White space collapsed, zero-width characters dropped, cut to limit."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, "[​‌‍﻿]", ""), r"\s+", " ")), 1, limit)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def first_sentences(text: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, n), " ")


def slug(text: Column, limit: int = 30) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, limit)


def article_text(title: Column, summary: Column) -> Column:
    return F.concat(title, F.lit(" "), F.coalesce(summary, F.lit("")))


def char_shingles(text: Column, k: int = 3) -> Column:
    """Distinct lower-cased k-grams; the whole text if it is shorter. Linear in the text: shifted arrays of characters are joined."""
    low = F.lower(text)
    chars = F.split(low, "")
    grams = chars
    for i in range(1, k):
        grams = F.zip_with(grams, F.slice(chars, F.lit(i + 1), F.greatest(F.length(low), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.when(F.length(low) < k, F.array(low)).otherwise(F.filter(grams, lambda g: g.isNotNull())))


def local_time(ts: Column, offset: str = "INTERVAL '05:30' HOUR TO MINUTE") -> Column:
    return ts + F.expr(offset)


def dow_one_hot(date: Column) -> dict[str, Column]:
    return {f"dow_{d}": (F.weekday(date) == k).cast("double") for k, d in enumerate(("mon", "tue", "wed", "thu", "fri"))}


def half_away(x: Column, digits: int) -> Column:
    """x rounded in binary, as databases round doubles: x * 10^digits to the next whole number, halves away from zero. F.round takes the shortest
    decimal form instead, in which a product just below a half stays below it."""
    power = 10.0**digits
    return F.round(x * power, 0) / power


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNull(), None).otherwise(F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def serial_day(date: Column) -> Column:
    return F.datediff(date, F.lit("1899-12-30").cast("date"))


def parse_iso_ts(text: Column) -> Column:
    return F.try_to_timestamp(text)


def title_from_slug(url: Column, limit: int = 300) -> Column:
    """Title-cased last path part of a URL, hyphens as blanks."""
    return F.substring(F.initcap(F.translate(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$|/+$", ""), "/"), -1), "-", " ")), 1, limit)
