"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text recognises every substring of it. A
text is parsed against each automaton into the longest phrases the sample contains; the language that needs
the fewest phrases, normalised by the information in a phrase's position (log2 of the sample's length) and by the
text's length, wins. Texts and samples are sequences of UTF-8 bytes, so that every script has its own symbols in a small alphabet.

Texts are cut into lanes of LANE bytes that are parsed side by side (numpy), so that each step of the automaton is one
table lookup for thousands of lanes. A lane starts in the state in which the lane before it ends: lanes are parsed from the
root first, then those whose start turns out to be another state once more, and what still changes after PASSES rounds is parsed
lane by lane. The phrases are therefore those of the whole text, whatever its length.

Texts are lower-cased, and each run of characters that are neither letters nor marks becomes one blank. A null text or one
without a letter is `und` with score 0, and so is every text if nothing labelled was learned. Ties go to the first language by
name. Rows are decided each by its own text; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: Characters of labelled text kept for each language. A document lends one window of at most WINDOW_CHARS characters, at a
#: place that its hash decides, so texts of any length take part; DRAWN times the wanted characters are drawn by hash.
SAMPLE_CHARS = 30_000
WINDOW_CHARS = 1_500
DRAWN = 4
#: Label values that are learned at most: each takes an automaton of some 14 MB in a worker.
LANGUAGES = 64
LANE = 256
PASSES = 2
UNKNOWN = "und"
_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks, 0 for others."""
    if not _kinds:
        by = {"L": 2, "M": 1}
        _kinds.append(np.fromiter((by.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), dtype=np.uint8, count=0x110000))
    return _kinds[0]


def normalise(text: str) -> tuple[bytes, int]:
    """The text's letters and marks as lower-case UTF-8 with single blanks between, and the number of its letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kind()[points]
    letters = int(np.count_nonzero(kind == 2))
    keep = kind > 0
    keep[1:] |= kind[:-1] > 0  # of a run of others the first one stays, as a blank
    out = np.where(kind > 0, points, np.uint32(32))[keep]
    return out.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), letters


def labelled_sample(docs: DataFrame, train, chars: int = SAMPLE_CHARS, window: int = WINDOW_CHARS, seed: int = 7, languages: int = LANGUAGES) -> dict[str, str]:
    """For each language windows of labelled texts, in hash order, until `chars` characters are reached.

    A document is drawn where its 64-bit hash stays below a bound that follows from the sum of its language's windows, so that about
    DRAWN * chars characters a language reach the driver, however many documents there are; the one of the least hash is always drawn. Rows of one hash (equal id and text) are one
    window. Of more than `languages` label values those with the most labelled text are learned, ties by name."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.lit(seed), "doc_id", F.crc32("text")).alias("h"))
    size = F.length("text")
    sizes = known.groupBy("lang").agg(F.sum(F.least(size, F.lit(window))).alias("n"), F.min("h").alias("first")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    bounds = [(r["lang"], max(r["first"], min(2**63 - 1, int(2**64 * min(1.0, DRAWN * chars / max(r["n"], 1))) - 2**63))) for r in sizes]
    least = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
    drawn = known.join(F.broadcast(least), "lang").where(F.col("h") <= F.col("bound"))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.greatest(size - window + 1, F.lit(1))).cast("int")
    windows = drawn.select("lang", "h", F.substr("text", start + 1, F.lit(window)).alias("w")).groupBy("lang", "h").agg(F.min("w").alias("w"))
    out: dict[str, str] = {}
    for r in windows.orderBy("h", "lang").toLocalIterator():
        if len(have := out.get(r["lang"], "")) < chars:
            out[r["lang"]] = have + " " + r["w"]
    return {k: out[k] for k in sorted(out) if any(c.isalpha() for c in out[k])}


class Parser:
    """The automata of all languages."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        made = [normalise(samples[lang])[0] for lang in self.langs]
        self.tables = [Automaton(s) for s in made]
        self.bits = [float(np.log2(max(2, len(s)))) for s in made]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a byte by text and language, and the letters of each text."""
        clean, letters = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            s, letters[i] = normalise(text)
            clean.append(s if letters[i] else b"")
        size = np.array([len(s) for s in clean], dtype=np.int64)
        lanes_of = -(-size // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes_of)
        lanes = np.frombuffer(b"".join(s.ljust(int(n) * LANE, b"\xff") for s, n in zip(clean, lanes_of, strict=True)), dtype=np.uint8).reshape(-1, LANE)
        first = np.ones(len(owner), dtype=bool)
        first[1:] = owner[1:] != owner[:-1]
        out = np.zeros((len(texts), len(self.langs)))
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(owner, weights=table.phrases(lanes, first), minlength=len(texts))[: len(texts)] * self.bits[k]
        return out / np.maximum(size, 1)[:, None], letters


class Automaton:
    """Suffix automaton of a sample as a table: row offset of a state + symbol -> row offset of the next state; inverted (~) where a phrase starts.

    Symbols: the sample's own bytes, one for bytes it lacks (a phrase by itself), one for padding (nothing happens). 0xff, which UTF-8
    doesn't use, pads."""

    def __init__(self, sample: bytes):
        own = sorted(set(sample))
        other, pad, width = len(own), len(own) + 1, len(own) + 2
        self.symbol = np.full(256, other, dtype=np.uint8)
        self.symbol[own] = np.arange(len(own))
        self.symbol[0xFF] = pad
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in self.symbol[np.frombuffer(sample, dtype=np.uint8)].tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        start = np.zeros(width, dtype=np.int32)
        for c, t in nxt[0].items():
            start[c] = t
        table = np.tile(~(start * width), (len(nxt), 1))
        for i, moves in enumerate(nxt):
            for c, t in moves.items() if i else ():
                table[i, c] = t * width
            table[i, pad] = i * width
        table[:, other] = ~0
        self.table = table.astype(np.int32).ravel()

    def _run(self, steps: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases started in each lane (a column of steps) and the states at their ends."""
        state, phrases = state.copy(), np.zeros(len(state), dtype=np.int32)
        for c in steps:
            state = self.table[state + c]
            begun = state >> 31  # -1 where a phrase starts
            phrases -= begun
            state ^= begun
        return phrases, state

    def phrases(self, lanes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases started in each lane; `first` marks the lanes that begin a text, the others go on from the one before."""
        symbols = self.symbol[lanes]
        entry = np.zeros(len(lanes), dtype=np.int32)
        count, end = self._run(np.ascontiguousarray(symbols.T), entry)

        def wrong():
            want = np.where(first, 0, np.roll(end, 1)).astype(np.int32)
            return want, np.flatnonzero(want != entry)

        for _ in range(PASSES):
            want, redo = wrong()
            if not len(redo):
                return count
            entry[redo] = want[redo]
            count[redo], end[redo] = self._run(np.ascontiguousarray(symbols[redo].T), entry[redo])
        want, redo = wrong()
        table = memoryview(self.table)  # single look-ups in it are cheap, and nothing is copied
        for i in redo.tolist():
            while i < len(lanes) and not first[i] and entry[i] != end[i - 1]:  # and on to the lanes after it that this changes
                state, n = int(end[i - 1]), 0
                entry[i] = state
                for c in symbols[i].tolist():
                    state = table[state + c]
                    if state < 0:
                        state, n = ~state, n + 1
                count[i], end[i] = n, state
                i += 1
        return count


_parsers: dict[int, Parser] = {}


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text", keep: tuple[str, ...] = ("doc_id",), into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs plus a string and a double named by `into`, row by row; no shuffle."""
    if taken := {c.lower() for c in keep} & {c.lower() for c in into}:
        raise ValueError(f"docs has columns named {sorted(taken)}; choose other names by `into`")
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])

    def run(batches):
        samples = shared.value
        key = hash(tuple(samples.items()))
        if key not in _parsers:
            _parsers.clear()  # a worker keeps one parser
            _parsers[key] = Parser(samples)
        parser = _parsers[key]
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(batch.schema.names.index(text))]
            pred, score = [], []
            at = 0
            while at < len(texts):  # about a million characters at a time
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) < 1_000_000):
                    chars += len(texts[to])
                    to += 1
                bits, letters = parser.entropies(texts[at:to])
                for row, n in zip(bits, letters, strict=True):
                    if not n or not parser.langs:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    best = int(np.argmin(row))
                    second = float(np.partition(row, 1)[1]) if len(row) > 1 else 1e9
                    pred.append(parser.langs[best])
                    score.append(second / (second + float(row[best])))
                at = to
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=[*keep, *into])

    return docs.select(*keep, *({text} - set(keep))).mapInArrow(run, schema)


def predict_language(docs: DataFrame, train, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Fit on the documents for which `train` holds and predict all: doc_id, lang_pred, score."""
    return identify(docs.select("doc_id", "text"), labelled_sample(docs, train, chars))


def keep_known(docs: DataFrame, train, lang: str = "lang") -> DataFrame:
    """docs with `lang` set to the predicted language, without the rows of texts that have no letter; all other columns stay."""
    into = free_name(docs, "_lang_pred"), free_name(docs, "_score")
    out = identify(docs, labelled_sample(docs, train), keep=tuple(docs.columns), into=into).where(F.col(into[0]) != UNKNOWN)
    return out.withColumn(lang, F.col(into[0])).select(*docs.columns)
