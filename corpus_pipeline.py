"""The corpus pipeline: language, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes all its predecessor kept; its result is written as Parquet in the shared folder and read
again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import held_out, staged, table
from tidemark.llm.decontaminate import drop_leaks
from tidemark.llm.language import keep_known
from tidemark.llm.neardup import keep_first_of_groups
from tidemark.llm.packing import packing_digest
from tidemark.llm.secrets import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (`und`) and sets lang to the predicted language."""
    return keep_known(docs, ~held_out("doc_id", 4, 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group; texts of similarity 0.8 or more are linked."""
    return keep_first_of_groups(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their place in sequences of 1024 tokens."""
    return packing_digest(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("secret_scan", secret_scan), ("pack", pack)]
#: Hashing, trained automata and bin packing can't be said in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
