"""Operators on texts against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import decontaminate, language, neardup, packing, secrets, sharding
from tidemark.llm.common import components, held_out, table

RNG = random.Random(4)
TOKENS = ["password=", "Secret: ", "ToKeN = \"", "api_key:'", "AKIA" + "Q7" * 9, "AKIA12", "abc", "\n", " ", "é", "日本", "deadbeef" * 3,
          "0123456789abcdef0", "'", "=", "hunter2hunter2", "a.b-c_d/e+f=gh12", "😀", "apikey:", "passwd=token=secret: abcdefghijklmnop", "x1Y2z3W4v5U6t7S8r9Q0p1O2", "example12345678901234567890"]
ODD = [None, "", " ", "\n\n", "a", "日本語", "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop"]


def brute_secrets(text):
    text = text or ""
    spans = []
    n = Counter()
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            spans.append((m.start(), 0, m.end()))
            n["assign"] += 1
    for k, name, p, least in ((1, "access", r"AKIA[A-Z0-9]+", 18), (2, "hex", r"[0-9a-f]+", 16)):
        for m in re.finditer(p, text):
            if len(m[0]) >= least:
                spans.append((m.start(), k, m.end()))
                n[name] += 1
    return n, hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest(), spans


def brute_entropy(text, base):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
        body = m[0]
        if not re.search("[0-9]", body) or any(re.search(p, body) for p in secrets.ALLOW):
            continue
        limit = next(bits for p, bits in secrets.LIMITS if re.search(p, body))
        hot = []
        for i in range(len(body) - 19):
            c = Counter(body[i : i + 20])
            h = -sum(v / 20 * np.log2(v / 20) for v in c.values())
            if h >= limit - 1e-9:
                hot.append(i)
        if hot:
            s, e = m.start() + hot[0], m.start() + hot[-1] + 20
            if not any(a <= s and b >= e for a, _, b in base):
                out.append((s, 3, e))
    return out


def test_secrets_match_brute_force(docs_of):
    texts = ODD + ["".join(RNG.choice(TOKENS) for _ in range(RNG.randrange(1, 30))) for _ in range(150)]
    got = {r["doc_id"]: r for r in secrets.secret_digest(docs_of(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, digest, base = brute_secrets(t)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"], got[i]["base_sha256"]) == (n["assign"], n["access"], n["hex"], digest), t
        spans = sorted(base + brute_entropy(t, base))
        assert got[i]["spans"] == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans), t


def test_random_parts_beside_allowed_ones_are_secrets(docs_of):
    token = "Zx81kQ9vT2mN7pL4cR6w"
    key = "q8Zt3LmXv0Rb7KdYw2Hs" + "AAAAAAAA" + "n5Gc9PjUe4Ta1FoVi6Sk"
    hot = [f"https://host.com/reset/{token}", f"example_key={token}", f"host.com/a/b/{token}/c", f"changeme/{token}", f"k {key} k"]
    calm = ["host.com/docs/reference/getting-started/page12", "example12345678901234567890", "https://host.com/users/550e8400-e29b-41d4-a716-446655440000", "changeme-xxxxxxxxxxxx-2024",
            "your_example_key_placeholder_123"]
    got = {r["doc_id"]: r for r in secrets.secret_digest(docs_of(hot + calm)).collect()}
    for i, text in enumerate(hot):
        (span,) = got[i]["spans"].split(",")
        kind, start, end = span.split(":")
        part = key if key in text else token
        at = text.index(part)
        assert kind == "entropy" and int(start) <= at and int(end) >= at + len(part), text
    assert not any("entropy" in got[len(hot) + i]["spans"] for i in range(len(calm)))
    red = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs_of(hot)).collect()}
    assert not any(token in t or key in t for t in red.values())


def test_secrets_are_redacted_and_clean_texts_kept(docs_of):
    out = {r["doc_id"]: r for r in secrets.redact_secrets(docs_of(["é password=abcdefghijkl1 z", "clean text", None, ""])).collect()}
    assert out[0]["text"] == "é [SECRET] z" and out[0]["n_chars"] == len(out[0]["text"])
    assert out[1]["text"] == "clean text" and out[2]["text"] is None and out[3]["text"] == ""


def test_secret_scan_grows_in_proportion(docs_of):
    """Long candidates, runs of letters, many findings and paths of many parts end in seconds; what they yield is right."""
    rng = random.Random(11)
    b64 = "".join(rng.choice(secrets.ALPHABET) for _ in range(100_000))
    texts = [b64, "z" * 1_000_000, "deadbeef00112233 " * 30_000, "/".join(["part"] * 50_000) + "/1", "x" * 6 + "-" * 390 + "9Z", "1" + "-" * 100_000 + "xxxxxx", "é " * 300_000 + "password=abcdefghijkl1"]
    began = time.time()
    got = {r["doc_id"]: r for r in secrets.secret_digest(docs_of(texts)).collect()}
    red = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs_of(texts)).collect()}
    assert time.time() - began < 120
    assert got[0]["spans"].startswith("entropy:") and got[2]["n_hex"] == 30_000 and got[1]["spans"] == got[3]["spans"] == ""
    assert red[2] == "[SECRET] " * 30_000 and red[1] == texts[1] and red[6] == "é " * 300_000 + "[SECRET]"


def test_secret_scan_leaves_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "password=abcdefghijkl1", "mine", "also"), (None, None, None, None)], "doc_id long, text string, _secrets string, block string")
    rows = secrets.redact_secrets(docs).collect()
    assert [tuple(r) for r in rows] == [(1, "[SECRET]", "mine", "also"), (None, None, None, None)]
    assert secrets.redact_secrets(docs.limit(0)).count() == secrets.secret_digest(docs.limit(0)).count() == 0


def test_sharding_laws(docs_of, spark):
    texts = {i: t for i, t in enumerate(["same"] * 150 + ODD + [str(i) * (i % 50) for i in range(400)])}
    out = sharding.shard_digest(docs_of(texts)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    slots = defaultdict(list)
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_digest(docs_of(texts).repartition(5)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in out}
    few = sharding.shuffle_into_shards(docs_of(texts), 3, bucket_bytes=500)
    got = defaultdict(list)
    for r in few.collect():
        got[r["shard"]].append(r["slot"])
        assert r["text"] == texts[r["doc_id"]]
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    assert sharding.shard_digest(docs_of([])).count() == 0


def test_sharding_spreads_one_id_and_keeps_columns(spark, tmp_path):
    rows = [(None, f"text {i}", i, "a") for i in range(400)] + [(7, f"text {i % 3}", i, "b") for i in range(400)] + [(7, None, 0, "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bucket long, _order string")
    out = sharding.shuffle_into_shards(docs, 4, bucket_bytes=300)
    got = defaultdict(list)
    for r in out.collect():
        got[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    assert Counter(tuple(r)[:4] for r in out.collect()) == Counter(rows) and out.columns == [*docs.columns, "shard", "slot"]
    assert len({r["_bucket"] for r in out.where("doc_id is null and slot < 40").collect()}) >= 10
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs.withColumnRenamed("_bucket", "shard"), 4)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4, bucket_bytes=300)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r[0], r[1]) for r in rows)


def test_packing_round_trip(docs_of):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    words = ["the", "tion", "naïve", "don't", "\n", "  ", "12,5", "日本", "<|endoftext|>", "\t", "x" * 40, " ", "\x1c", " ", "."]
    texts = ODD + [RNG.choice(["", " "]).join(RNG.choice(words) + RNG.choice(["", " "]) for _ in range(RNG.choice([3, 40, 900, 2500]))) for _ in range(120)]
    out = packing.pack_documents(docs_of(texts)).collect()
    by_doc, bins = defaultdict(dict), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"]
        by_doc[r["doc_id"]][r["piece"]] = (r["start"], ids)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        whole = tok.encode(t or "", add_special_tokens=False).ids + [2]
        parts = [by_doc[i][k] for k in sorted(by_doc[i])]
        assert sum((p[1] for p in parts), []) == whole
        assert [p[0] for p in parts] == np.cumsum([0] + [len(p[1]) for p in parts[:-1]]).tolist()
        assert all(len(p[1]) == 1024 for p in parts[1:])
    total = 0
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(bins) <= -(-total // 1024) + 1
    digest = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.packing_digest(docs_of(texts)).collect()}
    assert digest == {(r["doc_id"], r["piece"]): zlib.crc32(r["ids"]) for r in out}


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "\t" * 1_000_000, ("x" + " " * 499) * 500 + "y", " " * 300_000 + "<|endoftext|>", "z" * 500_000])
def test_long_runs_are_encoded_as_the_tokenizer_does(text):
    from tokenizers import Tokenizer

    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        encoder = packing._Encoder(f.read())
    want = Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text), dtype="<u4").tolist() == want


def test_packing_odd_tables(spark, docs_of):
    assert packing.packing_digest(docs_of([])).count() == 0
    docs = spark.createDataFrame([(1, "a", 5, "x")] * 3 + [(None, None, 6, "y"), (2, " " * 100_000, 7, "z")], "doc_id long, text string, piece long, part string")
    out = packing.packing_digest(docs).collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter({1: 3, None: 1, 2: 1})
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)


@pytest.mark.parametrize("seed", range(4))
def test_fullest_combination_is_optimal(seed):
    rng = random.Random(seed)
    counts = np.zeros(61, dtype=np.int64)
    for _ in range(9):
        counts[rng.randrange(3, 40)] += rng.randrange(1, 3)
    for room in (17, 38, 60):
        best = {0}
        for length in range(61):
            for _ in range(counts[length]):
                best |= {b + length for b in best if b + length <= room}
        used = packing.fullest(counts, room, 60)
        assert sum(k * n for k, n in used.items()) == max(best) and all(n <= counts[k] for k, n in used.items())


def brute_phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n += 1
        i = max(j, i + 1)
    return n


def test_cross_parsing_counts_phrases():
    rng = random.Random(9)
    sample = {"a": "abracadabra alakazam abra", "b": "hocus pocus fidibus hocus", "j": "これは日本語の文です", "k": "이것은 한국어 문장", "z": "aaaaaaaa"}
    p = language.Parser(sample)
    texts = ["abracadabra", "hocusabra", "zzz abra", "ÄÖ hocus", "a", "日本 hocus", "हिन्दी में"]
    # Longer than a lane: random, a long copy of a sample, and periods that no lane falls into step with.
    texts += ["".join(rng.choice("abr cdou") for _ in range(3000)) + "x", "abracadabra alakazam abra" * 60, "a" * 5000, "aab" * 2000, "これは日本語" * 300]
    bits, letters = p.entropies(texts)
    for row, n, text in zip(bits, letters, texts, strict=True):
        clean, count = language.normalise(text)
        assert n == count == sum(c.isalpha() for c in text)
        for k, lang in enumerate(p.langs):
            assert row[k] * len(clean) / p.bits[k] == pytest.approx(brute_phrases(clean, language.normalise(sample[lang])[0]))


def test_normalised_texts_keep_letters_and_marks():
    assert language.normalise("12 Die\t\tKatze, 3 हिन्दी!") == ("die katze हिन्दी ".encode(), 11)
    assert language.normalise("") == (b"", 0) and language.normalise("\u0301 1") == ("\u0301 ".encode(), 0)


def test_language_learns_from_long_texts_of_any_script(spark, docs_of):
    words = {"en": "the cat and dog went out to see what they could of old town", "ja": "これ は 日本語 の 文 です そして 長い もの", "ko": "이것 은 한국어 문장 이고 길다 그리고 또", "zh": "这 是 中文 的 句子 而且 很 长 我们",
             "am": "ይህ የአማርኛ ጽሑፍ ነው ረጅም እና ሌላ " + " ".join(chr(0x1200 + i) for i in range(330) if chr(0x1200 + i).isalpha())}
    rng = random.Random(2)
    texts, langs = {}, {}
    for k, (lang, w) in enumerate(words.items()):
        w = w.split()
        for i in range(8):  # all longer than the sample
            texts[100 * k + i], langs[100 * k + i] = " ".join(rng.choice(w) for _ in range(12_000)), lang
        for i in range(8, 12):
            texts[100 * k + i], langs[100 * k + i] = " ".join(rng.choice(w) for _ in range(9)), lang
    docs = docs_of(texts, langs)
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(docs, F.col("doc_id") % 100 < 8).collect()}
    assert got == langs
    rows = docs.limit(3).withColumns({"score": F.lit("mine"), "LANG_PRED": F.lit(1), "_score": F.lit(2.5)})
    kept = language.keep_known(rows.unionByName(rows.withColumn("text", F.lit("12"))), F.lit(True))
    assert kept.columns == rows.columns and sorted(kept.collect()) == sorted(rows.collect())
    with pytest.raises(ValueError):
        language.identify(rows, {}, keep=tuple(rows.columns))


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = language.predict_language(docs, ~held_out("doc_id", 4, 2)).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id", 4, 2)).collect()
    assert len(out) > 150 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97


def test_language_odd_texts(docs_of):
    train = docs_of({**{i: "the cat and the dog went out to the sea" for i in range(4)}, **{i: "der hund und die katze gehen an das meer" for i in range(4, 8)}},
                    {i: "de" for i in range(4, 8)})
    odd = docs_of({10: None, 11: "", 12: "123 !!", 13: "the dog", 14: "die katze", 15: "日本"})
    from pyspark.sql import functions as F

    out = {r["doc_id"]: r for r in language.predict_language(train.union(odd), F.col("doc_id") < 8).collect()}
    assert [out[i]["lang_pred"] for i in (10, 11, 12)] == ["und"] * 3
    assert out[13]["lang_pred"] == "en" and out[14]["lang_pred"] == "de" and out[15]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language.predict_language(docs_of([]), F.lit(True)).count() == 0


def brute_groups(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in texts}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(docs_of):
    vocab = [f"w{i}" for i in range(60)]
    texts = ODD + ["one two", "ONE two", "one\x0btwo"]
    for _ in range(12):
        base = [RNG.choice(vocab) for _ in range(RNG.choice([30, 80, 200]))]
        for _ in range(RNG.randrange(1, 14)):
            copy = list(base)
            for _ in range(RNG.choice([0, 0, 1, 1, 2, 3])):
                copy[RNG.randrange(len(copy))] = RNG.choice(vocab)
            texts.append(" ".join(copy))
    texts = dict(enumerate(texts))
    want = brute_groups(texts)
    docs = docs_of(texts)
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    kept = neardup.keep_first_of_groups(docs.union(docs.limit(3)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert neardup.near_duplicates(docs_of([])).count() == 0


def test_pipeline_links_copies_from_similarity_80_on(spark, docs_of):
    import corpus_pipeline

    base = [f"w{i}" for i in range(104)]
    texts = {10 * g: " ".join(f"{w}g{g}" for w in base) for g in range(20)}
    for g in range(20):
        # One changed word takes 5 of 100 shingles: 2 leave 90 / 110 = 0.82, 3 leave 85 / 115 = 0.74.
        for copy, at in ((1, (30, 70)), (2, (25, 50, 75))):
            texts[10 * g + copy] = " ".join("new" if i in at else f"{w}g{g}" for i, w in enumerate(base))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs_of(texts), "").collect()}
    assert kept == {i for i, (_, c) in brute_groups(texts, 80).items() if i == c} == {10 * g + k for g in range(20) for k in (0, 2)}


def test_rows_of_null_or_shared_ids_are_decided_on_their_own_texts(spark, docs_of):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c), (3, a), (None, ""), (None, ""), (4, ""), (4, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], docs_of([]).schema)
    got = Counter((r["doc_id"], r["text"]) for r in neardup.keep_first_of_groups(docs).collect())
    assert got == Counter([(None, b), (1, c), (1, d), (3, a), (None, ""), (None, ""), (4, ""), (4, None)])
    items = spark.createDataFrame([(1, a[:80]), (2, c[:80])], "item_id long, text string")
    left = Counter((r["doc_id"], r["text"]) for r in decontaminate.drop_leaks(docs, items).collect())
    assert left == Counter((i, t) for i, t in rows if t not in (a, c))


def test_near_duplicates_of_shared_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(5, a), (5, b), (7, a.replace("a0 ", "q ")), (None, b), (None, c), (None, c), (2, d), (2, d), (None, None), (1, "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row long, _dropped string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == Counter([(5, 56, 5, True), (5, 56, 5, True), (7, 56, 5, False), (None, 56, 5, False), (None, 56, None, True), (None, 56, None, True),
                           (2, 56, 2, True), (2, 56, 2, True), (None, 0, None, True), (1, 0, 1, True)])
    kept = neardup.keep_first_of_groups(docs)
    assert kept.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, a), (5, b), (None, c), (2, d), (None, None), (1, "")])
    assert neardup.keep_first_of_groups(docs.where("doc_id = 7")).count() == 1


def test_near_duplicates_of_one_template(spark, docs_of):
    """Texts that share most of a template but fall short of the limit make no links, those that reach it do."""
    base = [f"t{i}" for i in range(300)]
    texts = {}
    for i in range(150):
        w = list(base)
        for k in range(6 if i % 10 else 2):
            w[(40 * k + 7 * i) % 300] = f"own{i}x{k}"
        texts[i] = " ".join(w)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs_of(texts)).collect()}
    assert got == brute_groups(texts)


def test_near_duplicates_on_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute_groups({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)] + [(500, i) for i in range(501, 540)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[150] == got[200] == got[100] == 100 and all(got[i] == 500 for i in range(500, 540))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edit_substring(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i]
        for j in range(1, len(t) + 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1])))
        prev = cur
    return min(prev)


def test_myers_distance():
    for _ in range(200):
        p = "".join(RNG.choice("abc") for _ in range(RNG.randrange(1, 90)))
        t = "".join(RNG.choice("abc") for _ in range(RNG.randrange(0, 60)))
        assert decontaminate.myers(p, t)[0] == edit_substring(p, t)


def test_leaks_of_items_that_repeat_a_phrase():
    phrase = "which of the following statements about water is true when it is "
    item = decontaminate.normalise(phrase + "heated " + phrase + "frozen")
    allowed = len(item) // decontaminate.RATE
    find = decontaminate.Matcher([(1, item)], decontaminate.RATE).find
    rng = random.Random(3)
    for _ in range(400):
        s = list(item)
        for k in rng.sample(range(1, len(item) // 2), allowed):  # all edits in the first half
            s[k] = "q"
        text = f"before it {''.join(s).strip()} and after it"
        want = edit_substring(item, decontaminate.normalise(text)) <= allowed if not find(text) else True
        assert bool(find(text)) == want, text


def test_leaks_of_periodic_items():
    found = decontaminate.Matcher([(1, "abc abd abc abd abc abd")], decontaminate.RATE).find("zebra zebra  abc qbd abc abd abc abd  lemon")
    assert [(i, d) for i, d, _, _ in found] == [(1, 1)]
    rng = random.Random(5)
    for _ in range(600):
        item = " ".join(rng.choice(["abc abd", "abc", "abd ab"]) for _ in range(rng.randrange(6, 16)))
        s = list(item)
        for _ in range(rng.randrange(0, 4)):
            s[rng.randrange(len(s))] = rng.choice(["q", "", "ab"])
        text = " ".join([rng.choice(["abc ", "zebra "]) * rng.randrange(3), "".join(s), rng.choice(["abd", "lemon"])])
        p = decontaminate.normalise(item)
        d = edit_substring(p, decontaminate.normalise(text))
        want = [(1, d)] if d <= len(p) // decontaminate.RATE else []
        assert [(i, x) for i, x, _, _ in decontaminate.Matcher([(1, item)], decontaminate.RATE).find(text)] == want, (item, text)


def test_leaks_odd_tables(spark, docs_of):
    docs = spark.createDataFrame([(1, "the same item here", "x", 1), (1, "the same item here", "x", 1), (None, "the same item here", "y", 2), (2, None, None, None), (3, "z" * 300_000, "z", 3)],
                                 "doc_id long, text string, __id string, item_id long")
    items = spark.createDataFrame([(5, "same item"), (5, "same item"), (None, "nowhere at all"), (6, "")], "item_id long, text string")
    assert Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()) == Counter({(1, 5): 4, (None, 5): 2})
    assert [tuple(r)[:1] for r in decontaminate.drop_leaks(docs, items).collect()] == [(2,), (3,)]
    assert decontaminate.drop_leaks(docs.limit(0), items).count() == 0 and decontaminate.drop_leaks(docs, items.limit(0)).count() == 5


def test_leaks_match_brute_force(spark, docs_of):
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    items = [" ".join(RNG.choice(vocab) for _ in range(RNG.randrange(6, 20))) for _ in range(12)] + ["", None, "one"]
    texts = list(ODD)
    for _ in range(60):
        item = RNG.choice(items[:12])
        s = list(item)
        for _ in range(RNG.randrange(0, 8)):
            k = RNG.randrange(len(s))
            s[k] = RNG.choice(["", "q", s[k] + "z"])
        texts.append(" ".join(RNG.choice(vocab) for _ in range(10)) + " " + "".join(s) + " " + RNG.choice(vocab))
    table_ = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_of(texts), table_).collect()}
    want = set()
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            p = decontaminate.normalise(item)
            if p and edit_substring(p, decontaminate.normalise(t)) <= len(p) // decontaminate.RATE:
                want.add((i, k))
    assert got == want and len(want) > 20
