"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import held_out, table


def op1_secret_scan(spark, sf_dir):
    from .secrets import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_shard(spark, sf_dir):
    from .sharding import shard_digest

    return shard_digest(table(spark, sf_dir, "documents"))


def op4_pack(spark, sf_dir):
    from .packing import packing_digest

    return packing_digest(table(spark, sf_dir, "documents"))


def op5_embedding_groups(spark, sf_dir):
    from .embeddings import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark, sf_dir):
    from .toxicity import predict_toxicity

    out = predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op7_token_counts(spark, sf_dir):
    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    from .language import predict_language

    docs = table(spark, sf_dir, "documents")
    out = predict_language(docs, ~held_out("doc_id", 4, 2))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op9_near_duplicates(spark, sf_dir):
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_main_text(spark, sf_dir):
    from .html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_nearest(spark, sf_dir):
    from .ann import nearest_vectors

    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark, sf_dir):
    from .audit import audit_filters

    return audit_filters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_ranked_search(spark, sf_dir):
    from .lexical import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    out = [op1_secret_scan, op2_decontaminate, op3_shard, op4_pack, op5_embedding_groups, op6_toxicity, op7_token_counts, op8_language,
           op9_near_duplicates, op10_main_text, op11_nearest, op12_filter_audit, op13_ranked_search]
    return {f.__name__: f for f in out}


def oracle_sql():
    from . import audit, lexical

    return {"op12_filter_audit": audit.ORACLE_SQL, "op13_ranked_search": lexical.ORACLE_SQL}
