"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams (with word borders) and of the word itself, so that
unseen misspellings share the vectors of what they have in common with known words. The words of a window of WINDOW
words are averaged and go into a linear softmax over the two classes; vectors and weights are trained together by
gradient steps. A text is as toxic as its worst window; since it is the text that is labelled, training takes two turns:
all windows bear their text's label, then toxic texts are represented by their worst windows. A logistic fit over the
texts' worst windows turns the result into a score.

The model is fitted on a bounded sample of labelled rows: at most SAMPLE texts of each class, chosen by hash; in the first turn at most
EPOCH_WINDOWS of their windows of each class an epoch, in the second all toxic texts' worst windows three times, the others'
worst ones once and at most CALM_WINDOWS more of the others' windows. Every window of every text is scored. Null and
empty texts, and those without a letter or digit, get the score of an empty window. Only the text is an input of a score. Rows are
scored each by itself, repeated ones too, and an empty table gives none; without labels every text gets score 0.5 of an unfitted model.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT_WORD, staged

SAMPLE = 2000
EPOCH_WINDOWS = 12_000
CALM_WINDOWS = 20_000
WINDOW = 16
DIM = 8
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
_WORD = re.compile(r"[^\W_]+")
CACHE = 150_000
#: Characters of a training text at most.
SAMPLE_CHARS = 30_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(word: str) -> list[int]:
    s = f"<{word}>"
    grams = [s]
    for n in GRAMS:
        grams += [s[i : i + n] for i in range(len(s) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


class Model:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.weights = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.sums = np.full(BUCKETS, 1e-6, dtype=np.float32)
        self.slope, self.shift = 1.0, 0.0

    def fit(self, texts: list[str], labels: list[int], turns: tuple[int, int] = (2, 2)) -> Model:
        docs = [words(t) for t in texts]
        vocab: dict[str, int] = {}
        ids = [np.array([vocab.setdefault(w, len(vocab)) for w in d], dtype=np.int64) for d in docs]
        parts = [subwords(w) for w in vocab]
        starts = np.cumsum([0] + [len(p) for p in parts])
        flat = np.concatenate([np.array(p) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        windows = [(k, i) for k, d in enumerate(ids) for i in range(0, len(d), WINDOW)]
        y = np.array(labels)
        if not windows:
            return self
        for _ in range(turns[0]):
            pos, neg = [w for w in windows if y[w[0]]], [w for w in windows if not y[w[0]]]
            self._epoch(ids, self._some(pos, EPOCH_WINDOWS) + self._some(neg, EPOCH_WINDOWS), y, starts, flat)
        for _ in range(turns[1]):
            worst = self._worst(ids, self.word_scores(starts, flat))
            pos = [(k, int(i)) for k, i in enumerate(worst) if y[k] and len(ids[k])]
            hard = [(k, int(i)) for k, i in enumerate(worst) if not y[k] and len(ids[k])]
            self._epoch(ids, pos * 3 + hard + self._some([w for w in windows if not y[w[0]]], CALM_WINDOWS), y, starts, flat)
        scores = self.word_scores(starts, flat)
        worst = np.array([self.window_logits(scores[d]).max() for d in ids])
        self._calibrate(worst, y)
        return self

    def _some(self, items: list, n: int) -> list:
        return items if len(items) <= n else [items[i] for i in self.rng.choice(len(items), n, replace=False)]

    def gradients(self, rows, target, starts, flat):
        """Of the summed softmax loss of windows (rows of word numbers): by weights, bias, and n-grams as (n-gram, gradient) rows."""
        used, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        counts = starts[used + 1] - starts[used]
        sub = np.concatenate([flat[starts[u] : starts[u + 1]] for u in used])
        word = np.add.reduceat(self.vectors[sub], np.cumsum(counts) - counts, axis=0) / counts[:, None]
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        size = np.bincount(of, minlength=len(rows)).astype(self.vectors.dtype)
        mean = np.zeros((len(rows), DIM), dtype=self.vectors.dtype)
        np.add.at(mean, of, word[inverse])
        mean /= size[:, None]
        z = mean @ self.weights + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), target] -= 1
        g = p @ self.weights.T / size[:, None]
        by_word = np.zeros((len(used), DIM), dtype=self.vectors.dtype)
        np.add.at(by_word, inverse, g[of])
        return mean.T @ p, p.sum(axis=0), sub, np.repeat(by_word / counts[:, None], counts, axis=0)

    def _epoch(self, ids, windows, y, starts, flat, batch: int = 128, rate: float = 0.4) -> None:
        for b in np.array_split(self.rng.permutation(len(windows)), max(1, len(windows) // batch)):
            rows = [ids[windows[i][0]][windows[i][1] : windows[i][1] + WINDOW] for i in b]
            by_weights, by_bias, sub, step = self.gradients(rows, np.array([y[windows[i][0]] for i in b]), starts, flat)
            self.weights -= 0.02 * by_weights
            self.bias -= 0.002 * by_bias
            np.add.at(self.sums, sub, (step**2).mean(axis=1))
            np.add.at(self.vectors, sub, -rate * step / np.sqrt(self.sums[sub])[:, None])

    def bucket_scores(self) -> np.ndarray:
        """What each n-gram adds to the toxic class's lead; the model is linear, so scoring needs no more."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def lead(self) -> float:
        return float(self.bias[1] - self.bias[0])

    def word_scores(self, starts, flat) -> np.ndarray:
        return np.add.reduceat(self.bucket_scores()[flat], starts[:-1]) / np.diff(starts)

    def window_logits(self, scores: np.ndarray) -> np.ndarray:
        return sliding_means(scores) + self.lead() if len(scores) else np.array([self.lead()])

    def _worst(self, ids, scores) -> np.ndarray:
        return np.array([int(np.argmax(self.window_logits(scores[d]))) if len(d) else 0 for d in ids])

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic fit of labels (equal weight to both classes) on worst windows, by Newton steps with a small ridge."""
        spread = x.std() or 1.0
        m, u = x.mean(), (x - x.mean()) / spread
        a, c = 1.0, 0.0
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * u + c, -30, 30)))
            r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
            ga, gc = (r * u).sum() + 1e-3 * a, r.sum()
            haa, hac, hcc = (h * u * u).sum() + 1e-3, (h * u).sum(), h.sum()
            det = haa * hcc - hac * hac or 1e-12
            a, c = a - (hcc * ga - hac * gc) / det, c - (haa * gc - hac * ga) / det
        self.slope, self.shift = float(a / spread), float(c - a * m / spread)

    def export(self) -> tuple[np.ndarray, float, float, float]:
        return self.bucket_scores().astype(np.float32), self.lead(), self.slope, self.shift


def sliding_means(scores: np.ndarray) -> np.ndarray:
    """Means of every run of WINDOW words (one of all words, if fewer)."""
    n = min(WINDOW, len(scores))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    return (total[n:] - total[:-n]) / n


class _Scores(dict):
    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets.tolist()

    def __missing__(self, word: str) -> float:
        parts = subwords(word)
        s = sum([self.buckets[p] for p in parts]) / len(parts)
        if len(word) <= KEPT_WORD:
            if len(self) > CACHE:
                self.clear()
            self[word] = s
        return s


_scorers: dict[int, _Scores] = {}


def training_texts(docs: DataFrame, labels: DataFrame, train, per_class: int = SAMPLE, seed: int = 5, chars: int = SAMPLE_CHARS) -> list:
    """At most per_class texts of each class, in order of a hash of the id; of a text of more than `chars` characters a window of that
    size, at a place that the hash decides. So at most 2 * per_class * chars characters reach the driver."""
    known = labels.where(F.col("toxic").isin(0, 1) & train).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    first = [known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(per_class).select("doc_id", "toxic", "h") for label in (0, 1)]
    picked = staged(first[0].unionByName(first[1]), "picked")  # 2 * per_class rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").where("text is not null")
    # Where rows share an id, the one of the smallest text's checksum is taken.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.crc32("text")).alias("text"))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int")
    return rows.orderBy("doc_id").select(F.substr("text", start + 1, F.lit(chars)).alias("text"), "toxic").collect()  # 2 * per_class rows at most


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of docs(doc_id, text); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model.export())

    def run(batches):
        buckets, lead, slope, shift = shared.value
        key = zlib.crc32(buckets.tobytes())
        if key not in _scorers:
            _scorers.clear()  # a worker keeps one model
            _scorers[key] = _Scores(buckets)
        scorer = _scorers[key]
        for batch in batches:
            out = []
            for t in batch.column(1):
                found = words(t.as_py())
                s = np.fromiter(map(scorer.__getitem__, found), dtype=np.float64, count=len(found))
                worst = (float(sliding_means(s).max()) if len(s) else 0.0) + lead
                out.append(1 / (1 + np.exp(-np.clip(slope * worst + shift, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array([int(p >= 0.5) for p in out], pa.int32())],
                                             names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def predict_toxicity(docs: DataFrame, labels: DataFrame, train) -> DataFrame:
    rows = training_texts(docs, labels, train)
    model = Model().fit([r["text"] for r in rows], [int(r["toxic"]) for r in rows])
    return score_toxicity(docs, model)
