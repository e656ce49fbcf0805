"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may differ from a passage by k = m // RATE edits. It is split into
k + 1 pieces, one of which any such passage holds unchanged; an automaton over the pieces of all items finds
their exact hits in one pass over each text. Every hit fixes where the item would lie, and Myers' bit-parallel
distance verifies that window. Hits that fall into one window are verified once.

Texts and items are lower-cased and reduced to words joined by one blank, with a blank at either end, so
that items match at word borders. An item of fewer than RATE characters is allowed no edit: it is found as the words it is,
even where that is one common word. Null and empty texts match nothing; empty items are skipped. Equal items are
reported each, and repeated rows too. Items go to the tasks in blocks of bounded size, each block against all documents; a worker
keeps the automaton of the last block only.

A hit is passed over only if its item's window there was verified before: windows are kept by the starts they cover.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 20
BLOCK_BYTES = 8 << 20
_WORDS = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    words = _WORDS.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces that cover the item."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and any substring of text, and the end of the first such one."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: int):
        self.items = [(i, s, len(s) // rate) for i, t in items if (s := normalise(t))]
        self.auto = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, s, k) in enumerate(self.items):
            for at, piece in pieces(s, k):
                where.setdefault(piece, []).append((n, at))
        for piece, uses in where.items():
            self.auto.add_word(piece, (len(piece), uses))
        if where:
            self.auto.make_automaton()
        self.empty = not where

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, errors allowed, end) for each item found, at its best window."""
        s = normalise(text)
        if not s or self.empty:
            return []
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, set[int]] = {}  # starts whose occurrences lie in a window verified before
        for last, (size, uses) in self.auto.iter(s):
            for n, at in uses:
                _, item, k = self.items[n]
                if best.get(n, (1, 0))[0] == 0:
                    continue
                start = last + 1 - size - at
                near = done.setdefault(n, set())
                if start in near:
                    continue
                lo, hi = max(0, start - 2 * k), min(len(s), start + len(item) + 2 * k)
                near.update(range(start - k, start + k + 1))
                d, end = myers(item, s[lo:hi])
                if d <= k and d < best.get(n, (k + 1, 0))[0]:
                    best[n] = (d, lo + end)
        return [(self.items[n][0], d, self.items[n][2], end) for n, (d, end) in best.items()]


_matchers: dict[int, Matcher] = {}


def _blocks(items: DataFrame):
    """The items in broadcast blocks of about BLOCK_BYTES."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").alias("item")).where("item is not null")
    size = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b).collect()]  # about BLOCK_BYTES at most
        yield items.sparkSession.sparkContext.broadcast(block)


def find_leaks(docs: DataFrame, items: DataFrame, rate: int = RATE) -> DataFrame:
    """One row per (document row, item) found: doc_id, item_id, distance, allowed, end_char (in the normalised text)."""
    out = None
    for shared in _blocks(items):
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
            _matching(shared, rate), "doc_id long, item_id long, distance int, allowed int, end_char long")
        out = found if out is None else out.unionByName(found)
    return out


def _matcher(block: list, rate: int) -> Matcher:
    key = hash((tuple(block), rate))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(block, rate)
    return _matchers[key]


def _matching(shared, rate: int):
    def run(batches):
        matcher = _matcher(shared.value, rate)
        for pdf in batches:
            rows = [(doc_id, *hit) for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True) for hit in matcher.find(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "allowed", "end_char"])

    return run


def _clean(shared, rate: int):
    def run(batches):
        matcher = _matcher(shared.value, rate)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column("text")], pa.bool_()))

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, rate: int = RATE) -> DataFrame:
    """docs without the rows that hold a benchmark item; each row is decided on its own text, whatever its doc_id."""
    for shared in _blocks(items):
        docs = docs.mapInArrow(_clean(shared, rate), docs.schema)
    return docs
