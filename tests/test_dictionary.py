"""Large dictionaries against the regular expression's rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins

TEXTS = {0: "The Bank of India rises. bank of india, BANK", 1: "bank-of india bank  of india bank of  india", 2: "a.net asp.net .net x.net", 3: "at&t AT&T cat&t at&tx", 4: "yahoo! yahoo!x yahoo",
         5: "Straße über straßen", 6: None, 7: "", 8: "bank of bank of india ltd", 9: "_bank bank_ bank9 9bank bank", 10: "c++ c+++ c++x (c++)", 11: "İstanbul bank", 12: "a b a b a", 13: "...", 14: "new\nbank of\nindia"}
ALIASES = [("bank", "B"), ("bank of india", "BOI"), ("Bank of", "BO"), ("india", "IN"), (".net", "NET"), ("at&t", "T"), ("yahoo!", "Y"), ("c++", "CPP"), ("über", "U"), ("a b", "AB"), ("b a", "BA"),
           ("bank", "B2"), ("...", "DOTS"), (None, "N"), ("of\nindia", "NL"), ("straße", "S")]


def by_regex(texts, aliases):
    known = {}
    for a, s in aliases:
        if a is not None and re.search("[a-z0-9_]", a.lower()):
            known.setdefault(a.lower(), set()).add(s)
    pattern = re.compile(joins.tag_pattern(list(known)))
    out = {}
    for i, t in texts.items():
        for m in pattern.finditer((t or "").lower()):
            for s in known[m.group(1)]:
                out.setdefault((i, s), m.group(1))
    return {(i, s, k) for (i, s), k in out.items()}


def tagged(spark, texts, aliases):
    a = spark.createDataFrame(list(texts.items()), "article_id long, text string")
    d = spark.createDataFrame(aliases, "alias string, symbol string")
    return {tuple(r) for r in joins.tag_dictionary(a, d, F.col("text")).select("article_id", "symbol", "match_keyword").collect()}


def test_the_same_tags_as_the_regular_expression(spark):
    texts = {k: v for k, v in TEXTS.items() if k != 11}  # Java and Python lower that letter differently
    assert tagged(spark, texts, ALIASES) == by_regex(texts, ALIASES)


def test_random_texts_with_overlapping_aliases(spark):
    rng = random.Random(1)
    words = ["a", "b", "c", "aa", "b_"]
    aliases = [(" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5]))), f"s{rng.randrange(8)}") for _ in range(60)]
    texts = {i: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "-", "  "]) for _ in range(rng.randrange(30))) for i in range(120)}
    assert tagged(spark, texts, aliases) == by_regex(texts, aliases)


@pytest.mark.parametrize("bound", [1_000_000, 10])
def test_a_hundred_thousand_aliases(spark, monkeypatch, bound):
    monkeypatch.setattr(joins, "bounded_broadcast", lambda df: df if bound == 10 else F.broadcast(df))
    aliases = spark.range(100_000).select(F.concat(F.lit("Firm "), F.col("id").cast("string")).alias("alias"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("symbol"))
    a = spark.createDataFrame([(i, f"News of firm {i * 997 % 120_000} and Firm {i}, not firm{i} nor affirm {i}") for i in range(300)], "article_id long, text string")
    got = {(r["article_id"], r["symbol"]) for r in joins.tag_dictionary(a, aliases, F.col("text")).collect()}
    assert got == {(i, f"S{n}") for i in range(300) for n in (i, i * 997 % 120_000) if n < 100_000}


def test_empty_dictionary_and_limits(spark):
    assert tagged(spark, TEXTS, [(None, "x")]) == set()
    with pytest.raises(ValueError, match="tag_dictionary"):
        joins.tag_symbols(spark.createDataFrame([(1, "x")], "article_id long, t string"), [(f"a{i}", "s") for i in range(6000)], F.col("t"))


def test_runs_are_handed_on_in_bounded_batches(spark):
    """A batch of many words makes small batches, and runs that can't be aliases none."""
    import pyarrow as pa

    table = spark.createDataFrame([("bank of",)], "core string")
    task = joins._grams([1, 2], spark.sparkContext.broadcast(joins._bitmap(table)))
    texts = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["bank of " * 30_000, None, "other words " * 50_000])], names=["article_id", "text"])
    got = [b.num_rows for b in task(iter([texts]))]
    assert max(got) <= joins.RUN_ROWS + 2 and sum(got) == 30_000


def test_no_row_holds_an_articles_hits(spark):
    """Hits are judged one after the other, across batches, and not gathered in a list for each article."""
    import pyarrow as pa

    parts = [pa.RecordBatch.from_pydict({"article_id": ids, "keyword": words, "begin": pa.array(begins, pa.int32()), "size": pa.array(sizes, pa.int32())})
             for ids, words, begins, sizes in ((["x", "x"], ["a b", "b"], [0, 2], [3, 1]), (["x", "x", "y"], ["b c", "a b", "b c"], [2, 5, 0], [3, 3, 3]), ([None, None], ["b", "b"], [0, 4], [1, 1]))]
    got = [tuple(r.values()) for b in joins._leftmost(iter(parts)) for r in b.to_pylist()] if hasattr(joins, "_leftmost") else []
    a = spark.createDataFrame([(1, "a b " * 20_000)], "article_id long, text string")
    out = joins.tag_dictionary(a, spark.createDataFrame([("a b", "S"), ("b a", "T")], "alias string, symbol string"), F.col("text"))
    assert [tuple(r) for r in out.collect()] == [(1, "S", "a b")]
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    assert got == [("x", "a b", 0), ("y", "b c", 0), (None, "b", 0)]


def shuffled_rows(df):
    """Rows that the exchanges of a plan that ran have written."""
    out = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        rows = node.metrics().get("shuffleRecordsWritten")
        out.extend([rows.get().value()] if rows.isDefined() else [])
        for i in range(node.children().length()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_only_tags_are_shuffled(spark):
    """An article's hits are judged where its text is read: what goes to disk follows the tags, not the hits nor their symbols."""
    a = spark.createDataFrame([(i, "bank of india, " * 50) for i in range(200)], "article_id long, text string")
    d = spark.createDataFrame([("bank of", "X"), ("bank of", "Y"), ("india", "Y"), ("india", "Z")], "alias string, symbol string")
    out = joins.tag_dictionary(a, d, F.col("text"))
    assert {tuple(r) for r in out.collect()} == {(i, s, k) for i in range(200) for s, k in (("X", "bank of"), ("Y", "bank of"), ("Z", "india"))}
    assert sum(shuffled_rows(out)) <= 600


@pytest.mark.parametrize("bytes_held", [0, 128 << 20])
def test_held_and_joined_dictionaries_tag_alike(spark, monkeypatch, bytes_held):
    monkeypatch.setattr(joins, "HELD_BYTES", bytes_held)
    monkeypatch.setattr(joins, "GROUP_BYTES", 40)
    texts = {k: v for k, v in TEXTS.items() if k != 11}
    assert tagged(spark, texts, ALIASES) == by_regex(texts, ALIASES)
    a, none = spark.createDataFrame([(None, "bank"), (1, "bank")], "article_id long, text string"), spark.createDataFrame([], "alias string, symbol string")
    assert joins.tag_dictionary(a, none, F.col("text")).count() == 0
    got = joins.tag_dictionary(a, spark.createDataFrame([("Bank", "B")], "alias string, symbol string"), F.col("text")).collect()
    assert {tuple(r) for r in got} == {(None, "B", "bank"), (1, "B", "bank")}


@pytest.mark.parametrize("piece,run_rows", [(1 << 20, 20_000), (40, 3), (1, 1)])
def test_texts_are_tagged_in_pieces(spark, monkeypatch, piece, run_rows):
    """Pieces and shares of any size give the same tags, and no run goes from one text to the next."""
    import pyarrow as pa

    monkeypatch.setattr(joins, "PIECE", piece)
    monkeypatch.setattr(joins, "RUN_ROWS", run_rows)
    rng = random.Random(2)
    words = ["a", "b", "ü", "a_", "ab", ".", "a\n", "\nb"]
    aliases = [("".join(rng.choices(words, k=rng.randrange(1, 6))) if i % 2 else " ".join(rng.choices(words, k=rng.randrange(1, 6))), f"s{rng.randrange(5)}") for i in range(80)]
    texts = {i: "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(25))) for i in range(80)}
    known = {}
    for alias, symbol in aliases:
        if core := re.search(r"(?s)[a-z0-9_](?:.*[a-z0-9_])?", alias):
            known.setdefault((alias, core.group()), set()).add(symbol)
    table = spark.createDataFrame([(core, len(alias[: alias.index(core)].encode()), alias, sorted(s)) for (alias, core), s in known.items()], "core string, lead int, keyword string, symbols array<string>")
    held = spark.sparkContext.broadcast(joins._held(table.withColumn("hash", F.crc32("core")).toArrow()))
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values()))], names=["article_id", "text"])
    lengths = sorted({len(re.findall(joins.WORD, core)) for _, core in known})
    out = list(joins._tags(lengths, held)(iter([batch])))
    first = {}
    for r in (r for b in out for r in b.to_pylist()):
        key = r["article_id"], r["symbol"]
        first[key] = min(first.get(key, (r["pos"], r["match_keyword"])), (r["pos"], r["match_keyword"]))
    assert max(b.num_rows for b in out) <= run_rows
    assert {(*k, word) for k, (_, word) in first.items()} == by_regex(texts, aliases)


def test_a_large_dictionary_is_dealt_to_groups_of_texts(spark, monkeypatch):
    """Beyond the bound no task holds the dictionary and no hit is shuffled: texts go to groups once, with the aliases whose hashes stand there."""
    monkeypatch.setattr(joins, "HELD_BYTES", 0)
    monkeypatch.setattr(joins, "GROUP_BYTES", 1000)
    rng = random.Random(3)
    words = ["a", "b", "c", "aa", "b_", "ü"]
    aliases = [(" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5]))) + rng.choice(["", "", "!"]), f"s{rng.randrange(8)}") for _ in range(60)]
    texts = {i: "".join(rng.choice(words) + rng.choice([" ", " ", "! ", "-"]) for _ in range(rng.randrange(60))) for i in range(150)}
    a, d = spark.createDataFrame(list(texts.items()), "article_id long, text string"), spark.createDataFrame(aliases, "alias string, symbol string")
    out = joins.tag_dictionary(a, d, F.col("text"))
    want = by_regex(texts, aliases)
    assert {tuple(r) for r in out.collect()} == want
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
