"""Ranked lexical search: term-at-a-time scoring with limited accumulators, exact for the k best.

Terms are runs of `[0-9A-Za-z]` and characters from U+0080 on, with A-Z lower-cased. One pass over the documents writes
for each of them its number of terms and the counts of those terms that any query holds (the texts don't travel).
Sums over that table give N, L and the df of each query term; weights follow from them.

Scoring takes the table's rows as they lie, in blocks of BLOCK documents. In a block the terms of a query are taken rarest
first. A document gets an accumulator from the first of its terms that opens it; once the remaining terms together
cannot bring a new document to the k-th score so far, no more accumulators are opened, and the remaining terms update
only the open ones. That score is the largest of three lower bounds of the k-th final score over all documents: the
k-th partial score in the block, the k-th final score that the task has met so far, and the k-th score among SEED documents
drawn by hash, which are scored first. Bounds only leave out what cannot be among the k best, so the result is the exact one.
A task emits for a query at most k rows a block, and only rows that reach its bound; Spark merges them.

Queries come in blocks of at most about QUERY_BYTES of their texts, each with its own pass; what a block's terms take on
the driver and in the workers is bounded by that. An item longer than the bound is a block of its own.

Results: a null text or one without terms is never found; a null or term-less query finds nothing. Each row of documents
counts as a document, repeated ones and those of a null or shared doc_id too; equal scores go by ascending doc_id, null
last. Rows of the queries that share an item_id share its results once for each row. Further columns, of any name, are
not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

BLOCK = 4096
SEED = 20_000
QUERY_BYTES = 4_000_000
#: Separators to blanks, A-Z to a-z; UTF-8 bytes from 0x80 on belong to terms.
_FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, in 64-bit integers; wider ones where a product would not fit."""
    tf, n, w = (a.astype(np.int64) for a in (tf, n, w))
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
        n = n.astype(object)
    m = (75 + (25 * n * n_docs) // total).astype(np.int64)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def best_of(score: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then ascending id, null ids last."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= kth)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], none[at], -score[at]))][:k]


def score_block(starts: np.ndarray, docs: np.ndarray, adds: np.ndarray, n_docs: int, query: list[tuple[int, int]], least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block with an exact score of at least `least`, and that score, by term-at-a-time with limited accumulators.

    The postings of term t are docs[starts[t]:starts[t + 1]] with what each adds; query: (term, repeats), rarest first."""
    lists = [(docs[starts[t] : starts[t + 1]], adds[starts[t] : starts[t + 1]] * repeats) for t, repeats in query if starts[t] < starts[t + 1]]
    rest = np.cumsum([int(a.max()) for _, a in lists][::-1])[::-1]  # the most that this term and all later ones can add
    acc, opened, opening = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool), True
    for (d, a), most in zip(lists, rest, strict=True):
        if opening:
            bound = least
            if opened.sum() >= k:
                bound = max(bound, int(np.partition(acc, n_docs - k)[n_docs - k]))
            opening = most >= bound
        if not opening:
            held = opened[d]
            d, a = d[held], a[held]
        acc[d] += a
        opened[d] = True
    found = np.flatnonzero(opened & (acc >= max(least, 1)))
    return found, acc[found]


def _postings(batch: pa.RecordBatch, n_terms: int, weights: np.ndarray, n_docs: int, total: int):
    lens = np.diff(batch.column("terms").offsets.to_numpy())
    term = batch.column("terms").flatten().to_numpy()
    doc = np.repeat(np.arange(batch.num_rows), lens)
    add = impacts(batch.column("tfs").flatten().to_numpy(), batch.column("n").to_numpy()[doc], weights[term], n_docs, total)
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(n_terms + 1)), doc[order], add[order]


def _scorer(queries: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, total: int, k: int, least: dict[int, int]):
    def run(batches):
        kth: dict[int, list[int]] = {}  # the k highest scores this task met, by query
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                starts, docs, adds = _postings(batch, len(weights), weights, n_docs, total)
                ids, none = batch.column("doc_id").fill_null(0).to_numpy(), np.asarray(batch.column("doc_id").is_null())
                out = ([], [], [])
                for number, query in queries:
                    met = kth.get(number, [])
                    bound = max(least.get(number, 1), met[-1] if len(met) == k else 1)
                    found, score = score_block(starts, docs, adds, batch.num_rows, query, bound, k)
                    if not len(found):
                        continue
                    top = best_of(score, ids[found], none[found], k)
                    kth[number] = sorted(met + score[top].tolist(), reverse=True)[:k]
                    out[0].append(np.full(len(top), number))
                    out[1].append(found[top])
                    out[2].append(score[top])
                if out[0]:
                    number, at, score = map(np.concatenate, out)
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), batch.column("doc_id").take(pa.array(at)), pa.array(score, pa.int64())],
                                                     names=["query", "doc_id", "score"])

    return run


def _counter(known: dict[bytes, int], seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64())), ("seed", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, draw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("draw").to_pylist(), strict=True):
                found = terms(text.as_py() or b"")
                if found:
                    counts = [(known[t], c) for t, c in Counter(found).items() if t in known]
                    rows.append((i, len(found), [t for t, _ in counts], [c for _, c in counts], int(draw < seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(documents: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    """(query, rank, doc_id, score) of one block of queries (number, text)."""
    spark = documents.sparkSession
    wanted = [(number, Counter(terms(text))) for number, text in items]
    known = {t: i for i, t in enumerate(sorted({t for _, c in wanted for t in c}))}
    text = F.col("text")
    # about SEED documents by a 64-bit hash, whatever their number
    n_rows = documents.count()
    cut = min(2**63 - 1, int(2**64 * min(1.0, SEED / max(n_rows, 1))) - 2**63)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64("doc_id", text).alias("draw"))
    table = rows.mapInArrow(_counter(known, cut), "doc_id long, n long, terms array<int>, tfs array<long>, seed int")
    lists = staged(table, "postings")
    n_docs, total = (lists.agg(F.count("*"), F.sum("n")).first())
    if not n_docs:
        return spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    df = dict(lists.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the terms of one block of queries
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(known))], np.int64)
    queries = [(number, sorted(((known[t], c) for t, c in counts.items()), key=lambda x: (df.get(x[0], 0), x[0]))) for number, counts in wanted if counts]

    def scored(part: DataFrame, least: dict[int, int]) -> DataFrame:
        some = part.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs")
        return some.mapInArrow(_scorer(queries, weights, n_docs, total, k, least), "query long, doc_id long, score long")

    first = _best(scored(lists.where("seed = 1"), {}), k)
    least = {q: s for q, s in first.where(F.col("rank") == k).select("query", "score").collect()}
    return _best(scored(lists, least), k).select("query", "rank", "doc_id", "score")


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """For each row of items(item_id, text) its k best rows of documents(doc_id, text): item_id, rank, doc_id, score."""
    spark = documents.sparkSession
    texts = items.where("text is not null").select(F.col("text").cast("binary").alias("text")).distinct().withColumn("size", F.octet_length("text"))
    distinct = staged(texts.withColumn("query", F.monotonically_increasing_id()), "items")  # the numbers hold once written
    blocks = max(1, math.ceil((distinct.agg(F.sum("size")).first()[0] or 0) / QUERY_BYTES))
    found = None
    for block in range(blocks):
        mine = distinct.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "text").collect()
        if mine:
            part = _search(documents, [(q, bytes(t)) for q, t in mine], k)
            part = staged(part, "ranked") if blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], "query long, rank int, doc_id long, score long") if found is None else found
    named = items.select("item_id", F.col("text").cast("binary").alias("text")).join(distinct.select("query", "text"), "text").select("item_id", "query")
    return found.join(named, "query").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH folded AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
 d AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM folded WHERE len(terms) > 0),
 g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
 q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 qt AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM q GROUP BY ALL),
 e AS (SELECT r, doc_id, n, unnest(terms) AS term FROM d),
 p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM e WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
 s AS (SELECT p.r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))) AS add FROM p JOIN w USING (term), g),
 scores AS (SELECT item_id, r, doc_id, sum(repeats * add)::BIGINT AS score FROM s JOIN qt USING (term) GROUP BY ALL),
 ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
