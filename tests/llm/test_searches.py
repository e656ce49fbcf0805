"""Nearest vectors, the filter audit and ranked search against brute force."""

import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, audit, lexical

# --- nearest vectors ----------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, score string, label int"


def vectors(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, e, "clash", 1) for i, e in rows], schema)


def sound(e):
    return e is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e) and any(v != 0 for v in e)


def brute(rows, k=10):
    """{query: sorted list of result lists}: repeated ids give several."""
    rows = [(i, e) for i, e in rows if sound(e)]
    out = {}
    for at, (i, e) in enumerate(rows):
        if i is not None and i % 100 == 0:
            near = sorted((math.dist(e, f), j is None, j or 0) for b, (j, f) in enumerate(rows) if b != at and len(f) == len(e))
            out.setdefault(i, []).append([(None if none else j, d) for d, none, j in near[:k]])
    return out


def found(df, k=10):
    out = {}
    for r in ann.nearest_vectors(df, F.col("vec_id") % 100 == 0, k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def same(got, want):
    assert set(got) == {q for q, lists in want.items() if any(lists)}
    for q, rows in got.items():
        expected = sorted((n + 1, j, d) for one in want[q] for n, (j, d) in enumerate(one))
        assert [(r[0], r[1]) for r in rows] == [(r[0], r[1]) for r in expected]
        assert np.allclose([r[2] for r in rows], [r[2] for r in expected], rtol=1e-12)


def test_nearest_on_odd_rows(spark):
    rng = random.Random(1)
    near = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    rows = [(i * 50, near[i % 30]) for i in range(60)]  # every vector twice
    rows += [(100, near[0]), (100, near[0]), (7, near[0])]  # repeated rows of a query
    rows += [(None, near[1]), (200, None), (300, []), (400, [0.0] * 4), (500, [1.0, None, 0.0, 0.0]), (600, [1.0, float("nan"), 0.0, 0.0]), (700, [1.0, float("inf"), 0.0, 0.0])]
    rows += [(800, [1.0, 2.0]), (801, [1.0, 2.5]), (802, [-0.0, 3.0]), (900, [5.0])]  # other lengths
    same(found(vectors(spark, rows)), brute(rows))


def test_nearest_with_ties_large_and_tiny_numbers(spark):
    rows = [(i, [1e200 * math.cos(i), 1e200 * math.sin(i)]) for i in range(0, 300, 20)] + [(i, [1e-200 * (i + 1), 0.0]) for i in range(1, 120, 9)]
    rows += [(100 * i, [float(i % 3), 1.0]) for i in range(10)] + [(i, [1.0, 1.0]) for i in range(1000, 1030)]
    same(found(vectors(spark, rows), 5), brute(rows, 5))


def test_nearest_of_few_or_no_rows(spark):
    assert found(vectors(spark, [])) == {}
    assert found(vectors(spark, [(0, [1.0, 2.0])])) == {}
    assert found(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])) == {}
    assert found(vectors(spark, [(0, [1.0, 2.0]), (2, [1.0, 3.0])])) == {0: [(1, 2, 1.0)]}
    floats = spark.createDataFrame([(0, [1.0, 2.0]), (2, [1.0, 3.0])], "vec_id int, embedding array<float>")
    assert found(floats) == {0: [(1, 2, 1.0)]}


def test_nearest_recall_and_exact_scores_on_many_lists(spark, monkeypatch):
    """Spread vectors, a dense third of near copies and a third of exact ones; lists and chunks small, finds handed on early."""
    for name, value in (("LIST", 16), ("CHUNK", 40), ("HELD", 3)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(4)
    spread, centre = rng.standard_normal((1200, 16)), rng.standard_normal(16)
    rows = [*spread, *(centre + 1e-3 * rng.standard_normal((900, 16))), *([centre * 2] * 900)]
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[p].tolist()) for i, p in enumerate(order)]
    got, want = found(vectors(spark, rows)), brute(rows)
    assert set(got) == set(want)
    hit = total = 0
    for q, one in want.items():
        exact = {j: math.dist(rows[q][1], rows[j][1]) for _, j, _ in got[q]}
        assert all(math.isclose(s, exact[j], rel_tol=1e-12, abs_tol=1e-15) for _, j, s in got[q]) and len(exact) == 10
        hit += sum(s <= one[0][9][1] * (1 + 1e-12) for _, _, s in got[q])
        total += 10
    assert hit / total >= 0.9


@pytest.mark.parametrize("dim", [2, 8, 24, 64])
def test_recall_of_the_lists_in_any_dimension(dim):
    """Uniform directions are the hardest case: the lists that are searched hold 0.9 of the nearest, whatever the dimension."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((12_000, dim))
    index = ann.build_lists(x[rng.permutation(len(x))[:1500]], 93)
    rows, lists = ann.boundary_lists(index, x)
    where = [set() for _ in x]
    for r, one in zip(rows.tolist(), lists.tolist(), strict=True):
        where[r].add(one)
    asked = np.arange(0, len(x), 100)
    rows, lists = ann.searched_lists(index, x[asked])
    chosen = [set(lists[rows == i].tolist()) for i in range(len(asked))]
    hits = []
    for i, q in enumerate(asked):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += [bool(where[j] & chosen[i]) for j in np.argsort(d)[:10]]
    assert np.mean(hits) >= 0.9


def test_lists_are_balanced_and_reached_by_the_graph():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((2000, 8)), 5 + 1e-3 * rng.standard_normal((2000, 8))])
    index = ann.build_lists(x, 64)
    assert len(index.centroids) == 64
    d = np.linalg.norm(x[:, None] / index.scale - index.centroids[None], axis=2)
    assert (index.centroids.mean(axis=1) * index.scale > 4).sum() == 32  # a dense half gets half of the lists
    ids, near = ann.nearest_lists(index, x / index.scale)
    assert np.isclose(near[:, 0], d.min(axis=1)).mean() > 0.99
    rows, lists = ann.searched_lists(index, x)
    chosen = set(zip(rows.tolist(), lists.tolist(), strict=True))
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(d <= index.ratio * d.min(axis=1, keepdims=True))), strict=True))
    assert len(chosen & want) >= 0.99 * len(want)
    rows, lists = ann.boundary_lists(index, x)
    assert set(rows) == set(range(len(x))) and np.bincount(rows).max() <= ann.REPLICAS


# --- filter audit -------------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fails(doc, docs):
    i, text = doc[0], doc[1] or ""
    words = WORDS.findall(text)
    return "".join(f for f, bad in zip("ABCDE", (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)),
        i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs)), strict=True) if bad)


def audited(docs, labels):
    rows = []
    said = {}
    for i, q, t in labels:
        a, b = said.get(i, (False, False))
        said[i] = (a or q == 1, b or t == 1)
    marked = [(d[3] or "", fails(d, docs), *(said.get(d[0], (False, False)) if d[0] is not None else (False, False))) for d in docs]
    for part in {m[0] for m in marked}:
        mine, shapley = [m for m in marked if m[0] == part], Counter()
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for n, f in enumerate(order):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                steps.append((order, n + 1, f, len(left), len(gone), sum(f in m[1] for m in mine) - len(gone), sum(m[1] == f for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)))
        rows += [(part, o, n, *rest, shapley[f]) for o, n, f, *rest in steps]
    return sorted(rows)


DOCS = "doc_id long, text string, lang string, source string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=0, n=140):
    rng = random.Random(seed)
    texts = ["", None, " ".join(f"w{i}" for i in range(250)), "x " * 200, "AB" + "c" * 97, "Ab" + "c" * 98, "a#b", "é ü x", "a\tb\nc\x0bd\x0ce\rf", "$" * 5000]
    ids = list(range(n))
    rng.shuffle(ids)
    docs = [(i if i % 13 else None, rng.choice(texts) if rng.random() < 0.8 else f"own {i}", "en", rng.choice(["a", "b", "b", "b", None]), "clash", 3) for i in ids]
    docs += [docs[0], docs[1], (ids[2], "other", "en", "a", "clash", 3)]  # repeated rows and ids
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, n, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return docs, labels


def rows_of(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


@pytest.mark.parametrize("batches", [1, 5])
def test_audit_equals_brute_force_in_any_order_of_files(spark, tmp_path, batches):
    docs, labels = corpus(batches)
    spark.createDataFrame(docs, DOCS).repartition(7, F.rand(3)).write.parquet(f"{tmp_path}/documents.parquet")
    out = audit.audit_filters(spark, f"{tmp_path}/documents.parquet", spark.createDataFrame(labels, LABELS), batches)
    assert rows_of(out) == audited(docs, labels)


def test_audit_goes_on_with_files_that_come_later_and_takes_a_batch_again(spark, tmp_path):
    docs, labels = corpus(9, 60)
    docs = sorted(docs, key=lambda d: -(d[0] or 0))  # smaller ids come later: every copy is retracted
    path, folder, said = f"{tmp_path}/documents.parquet", f"{tmp_path}/state", spark.createDataFrame(labels, LABELS)
    spark.createDataFrame(docs[:30], DOCS).coalesce(1).write.parquet(path)
    assert rows_of(audit.audit_filters(spark, path, said, 1, folder)) == audited(docs[:30], labels)
    new = spark.createDataFrame(docs[30:], DOCS)
    new.coalesce(1).write.mode("append").parquet(path)
    assert rows_of(audit.audit_filters(spark, path, said, 1, folder)) == audited(docs, labels)
    audit.take_batch(new, said, folder, 1)  # as after a driver's loss
    assert rows_of(audit.audit_filters(spark, path, said, 1, folder)) == audited(docs, labels)
    assert any(r["passing"] < 0 for r in spark.read.parquet(f"{folder}/counters/batch=1").collect())


def test_audit_of_an_empty_table_and_a_single_file(spark, tmp_path, sf):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert audit.audit_filters(spark, f"{tmp_path}/documents.parquet", spark.createDataFrame([], LABELS)).count() == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows_of(audit.audit_filters(spark, f"{sf}/documents.parquet", spark.read.parquet(f"{sf}/labels.parquet"))) == audited(docs, labels)


# --- ranked search ------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    known = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    known = [d for d in known if d[2]]
    n_docs, total = len(known), sum(d[2] for d in known)
    df = Counter(t for _, c, _ in known for t in c)
    out = []
    for item, text in items:
        query = words(text)
        scored = []
        for i, c, n in known:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in query if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, n + 1, d[3], -d[0]) for n, d in enumerate(sorted(scored, key=lambda d: d[:3])[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, score int, terms string")
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, query string")
    return sorted((tuple(r) for r in lexical.rank_documents(d, q, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def collection(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "ä", "日本", "x y", "İ", "ſ", "K"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 40])))) for i in range(n)]
    docs += [(n, None), (None, "w1 w2 w3 rare"), (None, "w1 w2 w3 rare"), (5, docs[5][1]), (n + 1, "W3," * 30_000), (n + 2, "\x00-_!")]
    docs += [(n + 10 + i, "copy of rare w9 w9") for i in range(150)]  # a third alike
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 12])))) for i in range(25)]
    items += [(100, None), (101, "--"), (102, "unknown"), (103, "rare rare w1"), (104, "RARE w9"), (104, "w3"), (None, "w5"), (105, items[0][1])]
    return docs, items


@pytest.mark.parametrize(("block", "seed_docs", "query_bytes", "k"), [(4096, 20_000, 4_000_000, 20), (16, 50, 4_000_000, 3), (7, 1, 100, 20)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, block, seed_docs, query_bytes, k):
    for name, value in (("BLOCK", block), ("SEED", seed_docs), ("QUERY_BYTES", query_bytes)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = collection(block)
    assert searched(spark, docs, items, k) == ranked(docs, items, k)


def test_ranked_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None), (2, "--")], [(1, "a")]) == []


def test_accumulators_are_limited_and_scores_stay_exact():
    """Documents with only the common term get no accumulator; those that have one go on being updated."""
    n = 1000
    rare, mid, common = np.arange(0, 30), np.arange(0, 300), np.arange(n)
    docs = np.concatenate([rare, mid, common])
    adds = np.concatenate([np.full(30, 100), np.full(300, 40), np.full(n, 10)]) + np.arange(len(docs)) % 3
    starts = np.array([0, 30, 330, 330 + n])
    got, score = lexical.score_block(starts, docs, adds, n, [(0, 1), (1, 2), (2, 1)], 1, 20)
    full = np.zeros(n, np.int64)
    np.add.at(full, docs, np.concatenate([adds[:30], 2 * adds[30:330], adds[330:]]))
    assert len(got) == 30 and (score == full[got]).all()  # 100 > 2 * 42 + 12 is the last rest that could still catch up
    assert lexical.impacts(np.array([5]), np.array([1 << 40]), np.array([7]), 1 << 40, 1 << 42).dtype == np.int64


def test_terms_fold_only_ascii():
    for text in ("Ab-Cd_9\x7fÄÖ日本İx", "", "\x00\x1f", "a b"):
        assert [t.decode() for t in lexical.terms(text.encode())] == words(text)


def test_queries_are_registered(spark, sf):
    from tidemark.llm import queries

    assert set(queries.oracle_sql()) == {"op12_filter_audit", "op13_ranked_search"} and {"op11_nearest"} < set(queries.queries())
    out = queries.op11_nearest(spark, sf)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 50
    assert os.path.exists(f"{sf}/embeddings.parquet")
