"""What workers keep, and what reaches the driver, is bounded in bytes."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import common, neardup, tokencount, toxicity


def test_long_words_are_not_kept_and_count_all_the_same():
    long = "x" * (common.KEPT_WORD + 1)
    counts = tokencount._Counts(tokencount.LongestMatch([bytes([b]) for b in range(256)]))
    assert counts[long] == len(long) and long not in counts and counts["ab"] == 2 and "ab" in counts
    scores = toxicity._Scores(np.zeros(toxicity.BUCKETS if hasattr(toxicity, "BUCKETS") else 1 << 20))
    assert scores[long] == 0 and long not in scores and scores["ab"] == 0 and "ab" in scores
    before = neardup.shingle_set(f"{long} b c d e f")
    assert long.encode() not in neardup._word_hash and b"b" in neardup._word_hash
    assert (neardup.shingle_set(f"{long} b c d e f") == before).all() and len(before) == 2


def test_training_texts_are_cut_to_windows(spark):
    docs = spark.createDataFrame([(i, ("word " * 4000 if i % 2 else "short"), 0.5) for i in range(20)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    got = toxicity.training_texts(docs, labels, F.lit(True), chars=1000)
    assert len(got) == 20 and {len(r["text"]) for r in got} == {5, 1000} and all(r["text"] in "word " * 4000 for r in got if r["toxic"])
