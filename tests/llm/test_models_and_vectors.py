"""Embeddings, token counts, toxicity and page text against brute force or held-out labels."""

import html as entities
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import embeddings, html, tokencount, toxicity
from tidemark.llm.common import held_out, table

RNG = random.Random(8)


def brute_embedding_groups(rows, least=0.93):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1])]
    comp, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=float), np.array(b[1], dtype=float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = sorted((root(a[0]), root(b[0])))
                    comp[q] = p
    return {i: (links[i], root(i)) for i in comp}


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def test_embedding_groups_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(25):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 9))):
            v = centre + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.2, 0.3])
            rows.append(([float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    rows += [(None, 1), ([], 1), ([0.0] * 32, 1), ([0.0] * 32, 1), ([float("nan")] * 32, 1), ([None] * 32, 1), ([1.0] * 32, None), ([1.0] * 32, None), ([1.0] * 31, 0)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    monkeypatch.setattr(embeddings, "CHUNK", 7)
    want = brute_embedding_groups(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (*v, i == v[1]) for i, v in want.items()}
    assert embeddings.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_embedding_links_of_large_groups_and_large_labels(spark, tmp_path):
    """A group of 700 near copies, 60 planted pairs at cosine 0.93 to 0.95 and 12,000 other vectors under one label, against all pairs in numpy."""
    rng = np.random.default_rng(21)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((12_000, 32)))
    side = rng.standard_normal((60, 32))
    side = unit(side - (side * x[:60]).sum(axis=1, keepdims=True) * x[:60])
    cos = rng.uniform(0.931, 0.95, (60, 1))
    near = unit(rng.standard_normal(32))
    x = np.concatenate([x, cos * x[:60] + np.sqrt(1 - cos**2) * side, unit(near + 0.04 * rng.standard_normal((700, 32)))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(None, x[0].tolist(), 1), (5, x[1].tolist(), 1)]
    got = embeddings.embedding_groups(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    y = unit(x.astype(np.float64))
    want = {(i, n) for i, n in enumerate((y @ y.T >= 0.93).sum(axis=1) - 1)}
    found = {(r["vec_id"], r["n_links"]) for r in got}
    assert sum(i > 1 and (i, n) not in found for i, n in want) <= 2 and len(got) == len(rows)
    one = {r["component_id"] for r in got if r["vec_id"] is not None and r["vec_id"] >= 12_060}
    assert len(one) == 1 and sum(r["component_id"] == min(one) for r in got) >= 700
    (null,) = [r for r in got if r["vec_id"] is None]
    assert null["component_id"] == 0 and not null["kept"] and null["n_links"] == 2  # vector 0 and its planted partner
    assert sum(r["vec_id"] == 5 for r in got) == 2 and {r["component_id"] for r in got if r["vec_id"] == 5} == {1, 5}


def test_embedding_recall_on_the_table(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_groups(df).collect()}
    assert got == brute_embedding_groups(rows)


@pytest.mark.parametrize("largest", [2_000, 100_000, 1_000_000])
def test_pairs_at_the_limit_meet_whatever_the_size_of_their_label(largest):
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((2, 3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    k, z, listed = embeddings.caps(largest)
    a, b = (embeddings.decode(v, embeddings.code(64, k), z / 8, listed) for v in (x, y))
    assert sum(not np.intersect1d(p, q).size for p, q in zip(a, b, strict=True)) <= 1


def test_decode_lists_every_direction_over_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = embeddings.code(16, 30)
    full = np.concatenate([np.concatenate([np.tile(u, (30, 1)), b], axis=1) for u in a]) / np.sqrt(2)
    for row, found in zip(x, embeddings.decode(x, (a, b), 0.5, least=5), strict=True):
        s = full @ row
        want = np.flatnonzero(s >= 0.5)
        assert set(found) == set(want if len(want) >= 5 else np.argsort(-s)[:5])


def greedy(word, vocab):
    n = i = 0
    while i < len(word):
        i += max(k for k in range(1, len(word) - i + 1) if word[i : i + k] in vocab)
        n += 1
    return n


def test_longest_match_counts():
    for _ in range(30):
        vocab = {bytes([c]) for c in b"abc"} | {bytes(RNG.choices(b"abc", k=RNG.randrange(2, 7))) for _ in range(12)}
        match = tokencount.LongestMatch(sorted(vocab))
        for _ in range(60):
            w = bytes(RNG.choices(b"abc", k=RNG.randrange(0, 25)))
            assert match.count(w) == greedy(w, vocab)


def test_token_counts_of_texts(docs_of):
    vocab = set(tokencount.vocabulary())
    texts = [None, "", " ", "the tionation, naïve 日本 <|endoftext|>", "don't stop", "x" * 3000, "\n\na"]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_bytes"]) for r in tokencount.count_tokens(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"\w+|[^\w\s]+", t or "")
        assert got[i] == (len(w), sum(greedy(x.encode(), vocab) for x in w), len((t or "").encode()))


def test_token_counts_of_vocabularies_that_agree_at_their_ends(docs_of):
    single = [bytes([b]) for b in range(256)]
    one, two = sorted([*single, b"abc", b"xyz"]), sorted([*single, b"acb", b"xyz"])
    docs = docs_of(["abc abc", "acb", None, "abc"])
    for vocab in (one, two, one):
        got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, vocab).collect()}
        assert got == {i: sum(greedy(w.encode(), set(vocab)) for w in (t or "").split()) for i, t in enumerate(["abc abc", "acb", None, "abc"])}
    assert tokencount.count_tokens(docs_of([])).count() == 0


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(len(scores))
    pos = np.array(labels) == 1
    return (ranks[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    out = toxicity.predict_toxicity(docs, labels, ~held_out("doc_id", 5, 0)).join(labels, "doc_id").where(held_out("doc_id", 5, 0) & F.col("toxic").isNotNull()).collect()
    y = [r["toxic"] for r in out]
    print("AUC", auc([r["score"] for r in out], y), "accuracy", np.mean([r["predicted"] == r["toxic"] for r in out]), len(out))
    assert auc([r["score"] for r in out], y) > 0.93  # 350 toxic texts to learn from; 0.999 with five times as many
    assert np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.95


def test_toxicity_gradients_match_differences():
    rng = np.random.default_rng(4)
    m = toxicity.Model(5)
    vocab = ["good", "day", "vile", "fool", "sea"]
    parts = [toxicity.subwords(w) for w in vocab]
    starts, flat = np.cumsum([0] + [len(p) for p in parts]), np.concatenate([np.array(p) for p in parts])
    m.vectors, m.weights = rng.normal(0, 0.5, m.vectors.shape), rng.normal(0, 0.5, m.weights.shape)
    m.bias = np.array([0.1, -0.2])
    rows, target = [np.array([0, 1, 1]), np.array([2, 3]), np.array([4, 2, 0, 1])], np.array([0, 1, 1])

    def loss():  # written out, word by word
        total = 0.0
        for words, y in zip(rows, target, strict=True):
            mean = np.mean([np.mean([m.vectors[g] for g in parts[w]], axis=0) for w in words], axis=0)
            z = mean @ m.weights + m.bias
            total -= z[y] - np.log(np.exp(z).sum())
        return total

    def slope(a, at, eps=1e-6):
        kept = a[at]
        a[at] = kept + eps
        up = loss()
        a[at] = kept - eps
        down = loss()
        a[at] = kept
        return (up - down) / (2 * eps)

    weights, bias, sub, by_gram = m.gradients(rows, target, starts, flat)
    assert weights == pytest.approx(np.array([[slope(m.weights, (i, j)) for j in (0, 1)] for i in range(toxicity.DIM)]), abs=1e-5)
    assert bias == pytest.approx(np.array([slope(m.bias, j) for j in (0, 1)]), abs=1e-5)
    total = np.zeros_like(m.vectors)
    np.add.at(total, sub, by_gram)
    for g in set(flat.tolist()):
        assert total[g, 3] == pytest.approx(slope(m.vectors, (g, 3)), abs=1e-5)


def test_toxicity_scores_match_brute_force(docs_of, spark):
    rng = np.random.default_rng(1)
    m = toxicity.Model(2)
    m.vectors, m.bias = rng.normal(0, 1, m.vectors.shape).astype(np.float32), np.array([0.3, 0.1], dtype=np.float32)
    m.slope, m.shift = 1.7, -0.4
    texts = [None, "", "?!", "one", " ".join(f"word{i % 7}" for i in range(16)), " ".join(f"w{i}" for i in range(40)), "x" * 200_000, "zu " * 50_000, "one"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs_of(texts), m).collect()}
    for i, t in enumerate(texts):
        found = toxicity.words(t)
        vectors = [np.mean(m.vectors[toxicity.subwords(w)].astype(float), axis=0) for w in dict.fromkeys(found)]
        of = {w: v for w, v in zip(dict.fromkeys(found), vectors, strict=True)}
        spans = [found[k : k + toxicity.WINDOW] for k in range(max(1, len(found) - toxicity.WINDOW + 1))][:60] if found else []
        leads = [(np.mean([of[w] for w in s], axis=0) @ m.weights + m.bias) @ np.array([-1, 1]) for s in spans] or [m.bias[1] - m.bias[0]]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(m.slope * max(leads) + m.shift))), abs=1e-4)
    assert toxicity.score_toxicity(docs_of([]), m).count() == 0


def test_toxicity_sample_is_bounded(docs_of, spark):
    labels = spark.createDataFrame([(i, i % 3 != 0) for i in range(300)], "doc_id long, t boolean").select("doc_id", F.col("t").cast("int").alias("toxic"))
    rows = toxicity.training_texts(docs_of([f"text {i}" for i in range(300)]), labels, F.lit(True), per_class=20)
    assert sorted(r["toxic"] for r in rows) == [0] * 20 + [1] * 20


def test_toxicity_learns_words_and_their_misspellings(docs_of, spark):
    plain = ["the sea was calm and the sky was clear today"] * 30 + ["we went along the road to the old town"] * 30
    toxic = ["the sea was calm you vile idiot and the sky was clear"] * 30 + ["we went along the road you idiots to the town"] * 30
    docs = docs_of(plain + toxic + ["what an idiotic day at the sea", None, "", "!!", "the calm sea and the old road"])
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.predict_toxicity(docs, labels, F.lit(True)).collect()}
    assert out[120]["predicted"] == 1 and out[124]["predicted"] == 0 and out[121]["score"] == out[122]["score"] == out[123]["score"]
    assert all(0 <= r["score"] <= 1 for r in out.values()) and len(out) == 125
    none = toxicity.predict_toxicity(docs, labels.limit(0), F.lit(True)).collect()
    assert len(none) == 125


def plain_article(page):
    inner = re.sub(r"<(br|p|/p|h1|/h1)>", " ", re.search(r"<article>(.*)</article>", page, re.S)[1])
    return re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", inner))).strip()


def test_page_text_on_the_table(spark, sf):
    pages = table(spark, sf, "pages")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    out = html.extract_main_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in out} == want
    assert all(r["n_chars"] == len(r["text"]) for r in out)


BLOG = """<html><head><title>x</title></head><body><div class="top-nav"><a href=/>Home</a> <a href=/b>B</a></div><div class="cookie-notice">We use cookies</div>
<div id="content"><div class="post-body"><h2>{title}</h2>{body}</div><div class="comments"><p>first! {title}</p><p>me too</p></div></div>
<div class="sidebar"><ul><li>one<li>two</ul></div><form>Mail <input><button>Go</button></form><div id="footer">(c)</div><script>var a = "<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize("n", [1, 12])
def test_page_text_without_article(spark, n):
    rows, want = [], {}
    for i in range(n):
        paras = [f"Para {i} {k} with   some &amp; text<br>and <b>bold</b>." for k in range(2 + i % 4)]
        body = "".join(f"<p>{p}</p>" if k % 2 else f"<p>{p}" for k, p in enumerate(paras)) + ("<ul><li>item a<li>item b</ul>" if i % 3 == 0 else "") + ("<div class='ad-box'>Buy!</div>" if i % 2 else "")
        rows.append((i, "http://blog.example.org/" + str(i), BLOG.format(title=f"Title {i}", body=body)))
        want[i] = " ".join([f"Title {i}", *(f"Para {i} {k} with some & text and bold." for k in range(2 + i % 4)), *(["item a", "item b"] if i % 3 == 0 else [])])
    rows += [(100, "http://blog.example.org/x", None), (101, None, ""), (102, "nonsense", "plain text only &lt;b"), (103, "http://e.org", "<p>a<p"), (104, "http://e.org", "<div><article><header><h1>T</h1></header>x</article></div>")]
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: out[i] for i in want} == want
    assert out[100] == out[101] == "" and out[102] == "plain text only <b" and out[103] == "a" and out[104] == "T x"


def texts_of_pages(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return {r["page_id"]: r["text"] for r in html.extract_main_text(df).collect()}


@pytest.mark.parametrize("shared", ["http://mirror.example.org/", "no address "])
def test_page_text_of_many_copies_of_one_page(spark, shared):
    page = "<html><body><nav>Seen {i} times</nav><article><h1>The title</h1><h2>Summary</h2><p>The only paragraph.</p></article></body></html>"
    rows = [(i, f"{shared}{i}", page.format(i=i)) for i in range(25)]
    # What all pages of a host share stays, if it is in the article.
    rows += [(100 + i, f"http://news.example.org/{i}", page.replace("The only", f"Paragraph {i}, the only").format(i=i)) for i in range(25)]
    out = texts_of_pages(spark, rows)
    assert {out[i] for i in range(25)} == {"The title Summary The only paragraph."}
    assert all(out[100 + i] == f"The title Summary Paragraph {i}, the only paragraph." for i in range(25))


def test_page_text_whatever_the_names_around_it(spark):
    pages = {
        1: '<body class="no-sidebar"><div class="with-header login-required"><h1>T{i}</h1><p>Body text {i} of some length.</p></div></body>',
        2: '<body class="has-sidebar"><nav>N</nav><article class="post tag-news category-social"><h1>T{i}</h1><p>Body text {i} of some length.</p></article></body>',
        3: '<body><form id="page"><div class="search"><input> Find</div><main class="social"><h1>T{i}</h1><p>Body text {i} of some length.</p></main></form></body>',
        4: '<body><article><div class="post-header"><h1>T{i}</h1></div><p>Body text {i} of some length.</p><div class="share"><a href=x>Tell others</a></div></article>'
           '<section id="comments"><article class="comment"><p>Long reader comment {i} number one, much longer than the article itself, and on and on.</p></article>'
           '<article class="comment"><p>Second reader comment {i}.</p></article></section></body>',
    }
    rows = [(100 * k + i, f"http://h{k}.example.org/{i}", page.replace("{i}", str(i))) for k, page in pages.items() for i in range(5)]
    rows += [(1000 + k, f"http://single{k}.example.org/", page.replace("{i}", "7")) for k, page in pages.items()]
    out = texts_of_pages(spark, rows)
    assert {k: v for k, v in out.items() if k < 1000} == {100 * k + i: f"T{i} Body text {i} of some length." for k in pages for i in range(5)}
    assert all(out[1000 + k] == "T7 Body text 7 of some length." for k in pages)


def test_page_text_of_deep_long_and_odd_pages(spark):
    deep = "<div>" * 5000 + "<p>The deep text.</p>" + "</div>" * 5000
    rows = [(1, "http://deep.example.org/", deep), (2, "http://deep.example.org/2", "<b>" * 5000 + "x"), (3, "http://long.example.org/", "<article>" + "<p>word</p>" * 60_000 + "</article>"),
            (4, "http://odd.example.org/", "</div></p>" * 3000 + "text"), (5, None, None), (6, None, ""), (6, None, ""), (7, "http://u.example.org", "<p>a" * 3000)]
    out = texts_of_pages(spark, rows)
    assert out[1] == "The deep text." and out[2] == "x" and out[3] == " ".join(["word"] * 60_000) and out[4] == "text" and out[5] == out[6] == "" and out[7] == " ".join(["a"] * 3000)
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, host string")
    assert html.extract_main_text(empty).count() == 0


def test_page_text_does_not_depend_on_the_order_of_pages(spark):
    rng = random.Random(6)
    blocks = ["<p>par {}</p>", "<h2>head {}</h2>", "<ul><li>a {}<li>b</ul>", "<table><tr><td>c {}</table>", "<blockquote>q {}</blockquote>", "<pre>code {}</pre>", "<div class='box'>x {}</div>",
              "<div class='ad'>Buy {}</div>", "<section><p>s {}</p></section>"]
    rows = [(i, "http://mixed.example.org/", f"<body><div id=menu><a href=1>One</a></div><div class=text><h1>Title {i}</h1>" + "".join(rng.choice(blocks).format(rng.random()) for _ in range(rng.randrange(5, 150))) + "</div></body>")
            for i in range(200)]
    first = texts_of_pages(spark, rows, 1)
    assert first == texts_of_pages(spark, rows[::-1], 7) and all(v.startswith(f"Title {k} ") and "Buy" not in v and "One" not in v for k, v in first.items())


def test_content_models_align_to_optionals_and_repeats():
    kids = lambda text: html.fold([(k, 0, 0) for k in text.split()])
    assert kids("h2 p h2 p") == [("h2", 0, 1), ("p", 0, 1)]
    assert html.align(kids("h2 p h2 p"), kids("h2 p table")) == [("h2", 0, 1), ("p", 0, 1), ("table", 1, 0)]
    assert html.align(kids("a"), kids("b a c")) == [("b", 1, 0), ("a", 0, 0), ("c", 1, 0)]
    rng = random.Random(1)
    model = kids("p")
    for _ in range(300):  # it stays bounded, and grows no more once it holds all keys
        model = html.align(model, kids(" ".join(rng.choice("abcdefghijklmnop") for _ in range(50))))
    assert len(model) <= html.LONGEST + 1 and all(o for _, o, _ in model)
    many = html.align(model, [(f"div.{i}", 0, 0) for i in range(2000)])
    assert len(many) < html.KEYS
