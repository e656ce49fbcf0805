"""Feed files, sitemaps and article pages as tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import text as tx


def feed_time(text: Column) -> Column:
    """A time with a zone, with or without a weekday before it, or in ISO form; null for anything else."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), tx.parse_iso_ts(plain))


def landed_documents(spark: SparkSession, path: str) -> DataFrame:
    """content: one row a file below path."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))


def _elements(documents: DataFrame, schema: str, at: str) -> DataFrame:
    """The elements at a place of each XML document; one that can't be parsed gives none."""
    parsed = F.from_xml(F.col("content"), schema, {"mode": "PERMISSIVE"})
    return documents.select(parsed.alias("x")).select(F.explode(F.col(f"x.{at}")).alias("e")).select("e.*")


_ITEM = "title string, link string, description string, pubDate string, updated string"


def landed_items(spark: SparkSession, path: str, element: str = "item") -> DataFrame:
    """The items of feed files below path, scanned by element: large files are split, and none is held as one value. Broken items go."""
    return spark.read.format("xml").option("rowTag", element).option("mode", "DROPMALFORMED").schema(_ITEM).load(path)


def read_feed_items(documents: DataFrame, source: str, fetched_at: Column) -> DataFrame:
    """The items of feed documents(content); the time is pubDate, else updated, else fetched_at. Items without a title go."""
    return feed_items(_elements(documents, f"channel struct<item array<struct<{_ITEM}>>>", "channel.item"), source, fetched_at)


def feed_items(items: DataFrame, source: str, fetched_at: Column) -> DataFrame:
    """Article rows of feed items, as read_feed_items gives them."""
    title, link = F.trim("title"), F.trim(F.coalesce("link", F.lit("")))
    return items.where(title != "").select(
        F.sha1(F.concat_ws("|", F.lit(source), link)).alias("article_id"), F.lit(source).alias("source"), title.alias("title"),
        F.substring(F.coalesce("description", F.lit("")), 1, 1000).alias("summary"), link.alias("link"),
        F.coalesce(feed_time(F.col("pubDate")), feed_time(F.col("updated")), fetched_at).alias("published_at"), fetched_at.alias("fetched_at"))


def sitemap_entries(documents: DataFrame, section: str, day: str) -> DataFrame:
    """loc, lastmod of the `url` elements of sitemaps(content) whose place contains section and whose time contains day."""
    urls = _elements(documents, "url array<struct<loc string, lastmod string>>", "url")
    return urls.select(F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod")).where(F.col("loc").contains(section) & F.col("lastmod").contains(day))


#: Where a page names its title and its time, best first.
TITLES = (r"(?is)<h1\b[^>]*class=[\"'][^\"']*(?:artTitle|article[^\"']*title)[^>]*>(.*?)</h1>", r"(?is)<h1\b[^>]*itemprop=[\"']headline[\"'][^>]*>(.*?)</h1>",
          r"(?is)<h1\b[^>]*>(.*?)</h1>")
TIMES = (r"(?is)<meta\b[^>]*property=[\"']article:published_time[\"'][^>]*content=[\"']([^\"']+)", r"(?is)<meta\b[^>]*name=[\"']publishdate[\"'][^>]*content=[\"']([^\"']+)",
         r"(?is)<meta\b[^>]*itemprop=[\"']datePublished[\"'][^>]*content=[\"']([^\"']+)", r"(?is)<time\b[^>]*datetime=[\"']([^\"']+)")
BODY = r"(?i)artText|article.*body"  # of a div's class; an article element is a body whatever its class
ASIDES = ("script", "style", "aside", "figure", "noscript")


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


class _Body(HTMLParser):
    """The text of the first body element, however its elements nest, without asides. An element that is never closed goes on to the page's end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body, self.aside, self.open, self.parts, self.ended = None, None, 0, [], False

    def handle_starttag(self, tag, attrs):
        if self.ended:
            return
        if self.body is None:
            kind = next((v or "" for k, v in attrs if k == "class"), "")
            if tag == "article" or tag == "div" and re.search(BODY, kind):
                self.body, self.open = tag, 1
        elif self.aside is not None:
            self.within += tag == self.aside
        elif tag in ASIDES:
            self.aside, self.within = tag, 1
        else:
            self.open += tag == self.body

    def handle_endtag(self, tag):
        if self.ended or self.body is None:
            return
        if self.aside is not None:
            self.within -= tag == self.aside
            if not self.within:
                self.aside = None
        elif tag == self.body:
            self.open -= 1
            self.ended = not self.open
        self.parts.append(" ")

    def handle_data(self, data):
        if self.body is not None and self.aside is None and not self.ended:
            self.parts.append(data)
            self.parts.append(" ")


@F.pandas_udf(StringType())
def article_body(html: pd.Series) -> pd.Series:
    """The body's text, white space collapsed; empty without a body or page."""

    def one(page):
        if not page:
            return ""
        parser = _Body()
        parser.feed(page)
        parser.close()
        return re.sub(r"\s+", " ", "".join(parser.parts)).strip()

    return html.map(one)


def extract_articles(pages: DataFrame, source: str, fallback_time: Column | None = None) -> DataFrame:
    """article_id, source, title, summary, link, published_at of pages(url, html); title of 10 characters or more and a time are needed.

    The summary is the first three sentences of a body of over 100 characters, else empty. A null page has no title and goes."""
    tries = [plain(F.regexp_extract("html", p, 1)) for p in TITLES]
    title = F.coalesce(*[F.when(t != "", t) for t in tries])
    when = F.coalesce(*[tx.parse_iso_ts(F.regexp_extract("html", p, 1)) for p in TIMES], *([] if fallback_time is None else [fallback_time]))
    body = article_body("html")
    out = pages.select(F.sha1(F.concat_ws("|", F.lit(source), F.col("url"))).alias("article_id"), F.lit(source).alias("source"), title.alias("title"),
                       F.when(F.length(body) > 100, F.substring(tx.first_sentences(body), 1, 1500)).otherwise("").alias("summary"), F.col("url").alias("link"), when.alias("published_at"))
    return out.where((F.length("title") >= 10) & F.col("published_at").isNotNull()).withColumn("title", F.substring("title", 1, 500))


def drop_blocked_pages(pages: DataFrame, marks: str = "captcha|access denied") -> DataFrame:
    """The pages that don't show one of the marks of a refused request; pages without html stay."""
    return pages.where(~F.coalesce(F.lower("html").rlike(marks), F.lit(False)))
