"""The pipeline's stages, each on its own input, and the whole of it."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import packing, secrets
from tidemark.llm.common import table

RNG = random.Random(12)
WORDS = "the sea was calm and a boat went out to find old friends near some small town by long roads".split()


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with clashing extra columns, null and shared ids, empty and very long texts, and a benchmark."""
    item = "which of these towns lies by the longest river of the northern plains"
    a, b = prose(80), prose(80)
    rows = [(1, a), (2, a), (3, a.replace("the", "a", 1)), (4, b + " " + item + " " + prose(20)), (5, prose(60) + " password=abcdefghijkl1 end"), (6, None), (6, ""), (7, "12 34 !!"),
            (None, prose(50)), (None, prose(50)), (8, prose(40)), (8, prose(40)), (9, prose(30_000)), (10, " ".join(["word"] * 3)), (11, prose(30) + " " * 50_000 + prose(5))]
    docs = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), "own", 1.5, "x", "y") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred double, _secrets string, _row string")
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows=rows, item=item, a=a)


def test_stages_keep_columns_and_clean_rows(spark, corpus):
    path, made = corpus
    docs = table(spark, path, "documents")
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    all_rows = Counter(made["rows"])

    out = stages["language_id"](spark, docs, path)
    assert out.columns == docs.columns and {r["lang"] for r in out.collect()} == {"en"}
    assert texts(out) == all_rows - Counter([(6, None), (6, ""), (7, "12 34 !!")])
    assert {(r["score"], r["lang_pred"], r["_secrets"], r["_row"]) for r in out.collect()} == {("own", 1.5, "x", "y")}

    out = stages["near_duplicates"](spark, docs, path)
    assert out.columns == docs.columns and texts(out) == all_rows - Counter([(2, made["a"]), made["rows"][2]])

    out = stages["decontaminate"](spark, docs, path)
    assert out.columns == docs.columns and texts(out) == all_rows - Counter([made["rows"][3]])

    out = stages["secret_scan"](spark, docs, path)
    got = texts(out)
    (hit,) = [t for i, t in made["rows"] if i == 5]
    assert out.columns == docs.columns and got == all_rows - Counter([(5, hit)]) + Counter([(5, hit.replace("password=abcdefghijkl1", "[SECRET]"))])
    assert all(r["n_chars"] == len(r["text"]) for r in out.where("text is not null").collect())

    out = stages["pack"](spark, docs, path).collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(i for i, _ in made["rows"])
    assert all(r["length"] <= packing.CAPACITY for r in out)


def test_the_whole_pipeline(spark, corpus):
    path, made = corpus
    out = corpus_pipeline.run(spark, path).collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter([1, 5, None, None, 8, 8, 9, 10, 11])
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)


def test_stages_of_empty_tables(spark, corpus):
    path, _ = corpus
    docs = table(spark, path, "documents").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0, name


def test_secret_scan_plan_is_native(spark, corpus):
    path, _ = corpus
    plan = secrets.redact_secrets(table(spark, path, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
