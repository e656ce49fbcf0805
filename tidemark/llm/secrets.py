"""Secret scans, all in DataFrame functions.

Base findings are regular-expression matches (assignments, access keys, hex runs). On top of them a
window of WINDOW characters slides over every candidate string that holds a digit; the counts of the
window's characters are kept incrementally (one enters, one leaves), packed into six numbers, and with them
sum(c*log2 c), so that the Shannon entropy of each window is known in constant time. A candidate whose windows reach the
limit of its character class yields one span, from the first such window to the end of the last. Candidates that are on
the allow list as a whole (UUIDs, plain numbers, placeholders, paths of words) yield none, nor do spans inside a base one.

Null and empty texts have no findings. Offsets are code points, end exclusive. A row's findings depend on its text alone:
ties, repeated rows and empty tables need no care. The work grows in proportion to a text, also to one long candidate or many
findings. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"  # those without a digit are passed over
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Least entropy in bits by class: hex digits, letters and digits, all candidate characters.
LIMITS = (("^[0-9a-fA-F]+$", 2.9), ("^[0-9A-Za-z]+$", 3.6), ("", 3.7))
_WORD = r"(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15})"
_WORDS = rf"{_WORD}(?:[_-]+{_WORD})*+"
_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: Whole candidates only. Random parts beside a placeholder, a run of one character or a path are left to their windows.
#: Repeats are possessive: no backtracking, whatever the length.
ALLOW = (
    rf"^{_UUID}$",
    r"^[0-9+/_=-]+$",
    r"(?i)^(?=.*(?:example|placeholder|changeme|x{6}|(.)\1{7}))(?:(?<![a-z0-9])[a-z]{1,15}(?![a-z0-9])|example|placeholder|changeme|x{6,}+|(.)\2{7,}+"
    r"|(?<![0-9])(?:0?123456789)++0?(?![0-9])|(?<![0-9])(?:1234567890)*+[0-9]{1,4}(?![0-9])|[+/_=-])++$",
    rf"^/?(?:{_WORDS}/)++(?:(?:{_WORDS})?[0-9]{{0,4}}|{_UUID})$",
)
#: Running sums are taken in blocks of this many.
BLOCK = 64
#: Packed counts: five bits a character, twelve characters a number.
BITS, EACH = 5, 12
_SPANS = "array<struct<start:int,kind:int,end:int,body:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of a list of numbers >= 0 all numbers before it, joined (0 at the first).

    Folds hold single numbers only, since what a fold carries is copied at each step."""
    fold = lambda some: F.aggregate(some, F.lit(0), lambda a, x: F.coalesce(join(a, x), F.lit(0)))
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def with_values(v):
        sums = F.transform(F.sequence(F.lit(0), block(F.size(v))), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

        def with_sums(t):
            bases = F.transform(t, lambda _, b: fold(F.slice(t, F.lit(1), b)))
            return _let(bases, lambda p: F.transform(v, lambda _, i: join(
                F.get(p, block(i)), fold(F.slice(v, block(i) * BLOCK + 1, F.pmod(i, F.lit(BLOCK)))))))

        return _let(sums, with_sums)

    return _let(values, with_values)


def _found(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start,kind,end,body>> of the leftmost non-overlapping matches, with their text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def with_pairs(pairs):
        ends = _before(F.transform(pairs, lambda x: x["gap"] + F.length(x["hit"])), lambda a, x: a + x)
        return F.zip_with(pairs, ends, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + F.length(x["hit"])).alias("end"),
                                                              x["hit"].alias("body")))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.when(text.rlike(pattern), _let(pairs, with_pairs)).otherwise(F.array()).cast(_SPANS)


def _clog(c: Column) -> Column:
    """c * log2 c for a count of 0 to WINDOW, from a table."""
    return F.get(F.array(*[F.lit(k * math.log2(k) if k > 1 else 0.0) for k in range(WINDOW + 1)]), c)


def _hot_window(body: Column) -> Column:
    """struct<first,last> in body: start of the first and end of the last window over the class's limit."""
    limit = F.lit(LIMITS[-1][1])
    for pattern, bits in reversed(LIMITS[:-1]):
        limit = F.when(body.rlike(pattern), F.lit(bits)).otherwise(limit)
    least = F.lit(WINDOW * math.log2(WINDOW)) - limit * WINDOW  # a window is hot while its sum is at most this
    words = -(-len(ALPHABET) // EACH)
    codes = F.transform(F.split(body, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    # Each position with the character that leaves there (-1: none yet).
    moves = F.zip_with(codes, F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), codes), F.lit(1), F.size(codes)),
                       lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    init = F.struct(*[F.lit(0).cast("long").alias(f"w{k}") for k in range(words)], F.lit(0.0).alias("s"), F.lit(0).alias("i"),
                    F.lit(-1).alias("first"), F.lit(-1).alias("last"), least.alias("least"))  # the limit is found once, not at each step
    one = F.lit(1).cast("long")

    def place(code):
        return F.call_function("shiftleft", one, F.pmod(code, F.lit(EACH)) * BITS)

    def count(acc, code):
        word = acc["w0"]
        for k in range(1, words):
            word = F.when(code >= k * EACH, acc[f"w{k}"]).otherwise(word)
        return F.call_function("shiftright", word, F.pmod(code, F.lit(EACH)) * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(acc, x):
        a, b, i = x["a"], x["b"], acc["i"] + 1
        n, m = count(acc, a), count(acc, b)  # before the move; the same character in and out changes nothing
        s = F.when(a == b, acc["s"]).otherwise(acc["s"] + _clog(n + 1) - _clog(n) + F.when(b >= 0, _clog(m - 1) - _clog(m)).otherwise(F.lit(0.0)))
        into = lambda code, k: F.when((code >= k * EACH) & (code < (k + 1) * EACH), place(code)).otherwise(F.lit(0).cast("long"))
        hot = (i >= WINDOW) & (s <= acc["least"] + 1e-9)
        return F.struct(*[(acc[f"w{k}"] + into(a, k) - into(b, k)).alias(f"w{k}") for k in range(words)], s.alias("s"), i.alias("i"),
                        F.when(hot & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"]).alias("first"),
                        F.when(hot, i).otherwise(acc["last"]).alias("last"), acc["least"].alias("least"))

    return F.aggregate(moves, init, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def find_secrets(docs: DataFrame, text: str = "text", into: str = "_secrets", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs plus `into`: sorted array<struct<start,kind,end,body>>; kind indexes KINDS.

    Native plan: no shuffle, no Python. `into` must not be a column of docs."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {into} already")
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_found(t, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["body"], ASSIGN, 1)) >= 12)
    df = docs.withColumn(into, F.concat(assign, _found(t, ACCESS, 1), _found(t, HEX, 2)))
    cands = F.filter(_found(t, CANDIDATE, 3), lambda x: x["body"].rlike("[0-9]") & ~_any(x["body"], allow))
    windows = F.transform(cands, lambda x: F.struct(x["start"].alias("at"), x["body"].alias("body"), _hot_window(x["body"]).alias("hot")))
    spans = F.transform(F.filter(windows, lambda x: x["hot"]["first"] >= 0), lambda x: F.struct(
        (x["at"] + x["hot"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["at"] + x["hot"]["last"]).alias("end"),
        F.substr(x["body"], x["hot"]["first"] + 1, x["hot"]["last"] - x["hot"]["first"]).alias("body")))
    df = df.withColumn(into, F.sort_array(F.when(t.rlike(CANDIDATE), F.concat(F.col(into), spans)).otherwise(F.col(into))))
    return df.withColumn(into, _outside_base(F.col(into)))


def _covered(spans: Column, base_only: bool) -> Column:
    """For each of the sorted spans the furthest end of those before it (of base ones only, or of all)."""
    return _before(F.transform(spans, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(F.lit(0)) if base_only else x["end"]), F.greatest)


def _outside_base(spans: Column) -> Column:
    """Sorted spans without those of windows that lie inside a base one; at equal starts base ones come first."""
    rest = _let(_covered(spans, True), lambda ends: F.filter(spans, lambda x, i: (x["kind"] < 3) | (x["end"] > F.get(ends, i))))
    return F.when(F.exists(spans, lambda x: x["kind"] == 3), rest).otherwise(spans)


def _any(col: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | col.rlike(p)
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base findings, sha256 of their list, and all spans as text."""
    df = find_secrets(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter(F.col("_secrets"), lambda x: x["kind"] == k)).cast("long")
    base = F.filter(F.col("_secrets"), lambda x: x["kind"] < 3)
    return df.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                     F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_secrets")).alias("spans"))


#: Texts are cut into pieces of this many characters before findings are replaced, so that none is walked from its start for each.
CUT = 4096


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by `mark`, n_chars renewed where it changed."""
    name = free_name(docs, "_secrets")
    df, spans, text = find_secrets(docs, into=name), F.col(name), F.col("text")
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))

    def between(pieces, start, end):  # the text from start to end
        first = F.floor(start / CUT).cast("int")
        some = F.slice(pieces, first + 1, F.floor(end / CUT).cast("int") - first + 1)
        return F.substr(F.array_join(some, ""), F.pmod(start, F.lit(CUT)) + 1, end - start)

    def whole(pieces, ends):
        kept = F.transform(spans, lambda x, i: F.when(x["start"] >= F.get(ends, i), F.concat(between(pieces, F.get(ends, i), x["start"]), F.lit(mark))))
        return F.concat(F.array_join(kept, ""), between(pieces, F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text)))

    hit = F.size(name) > 0
    redacted = _let(cut, lambda pieces: _let(_covered(spans, False), lambda ends: whole(pieces, ends)))
    df = df.withColumn("text", F.when(hit, redacted).otherwise(text))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*docs.columns)
