"""What the language model is taught, at any size."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import language

EN = "the quick brown fox jumps over the lazy dog while the old man reads his newspaper in the garden "
DE = "der schnelle braune fuchs springt über den faulen hund während der alte mann im garten die zeitung liest "


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, h string, score double")


def texts(n):
    rng = random.Random(2)

    def some(s):
        words = s.split()
        return " ".join(rng.choices(words, k=60))

    return [(i, some(EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(n)]


@pytest.mark.parametrize("drawn", [4, 1e-6])
def test_every_language_is_learned_however_small_the_share(spark, monkeypatch, drawn):
    """At a share far below a millionth, as in a very large corpus, each language still has a window."""
    monkeypatch.setattr(language, "DRAWN", drawn)
    rows = texts(40)
    out = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(docs(spark, rows), F.lit(True)).collect()}
    assert sum(out[i] == lang for i, _, lang in rows) >= 38 and "und" not in out.values()


def test_the_share_is_met_at_any_size(spark, monkeypatch):
    """The number of windows drawn follows the bound: about DRAWN * chars characters, of 4,000 texts."""
    rows = docs(spark, [(i, EN * 3, "en") for i in range(4000)])
    monkeypatch.setattr(language, "DRAWN", 1)
    sample = language.labelled_sample(rows, F.lit(True), chars=30_000)
    assert 20_000 <= len(sample["en"]) <= 30_000 + len(EN) * 3 + 1


def test_copies_of_a_null_id_are_one_window_and_only_the_largest_languages_are_learned(spark):
    rows = docs(spark, [(None, EN, "en")] * 500 + [(1, DE, "de"), (2, DE + "x", "de"), (3, "bonjour le monde", "fr"), (4, "hola", None), (5, None, "en")])
    sample = language.labelled_sample(rows, F.lit(True), languages=2)
    assert set(sample) == {"en", "de"} and sample["en"].strip() == EN.strip()
    assert language.labelled_sample(rows.limit(0), F.lit(True)) == {}
