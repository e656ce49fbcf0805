"""Token counts by a linear longest-match automaton.

The trie over the vocabulary has, for every node, a failure link and the number of tokens popped on the way:
when the next byte doesn't continue the node's string, its longest tokens are cut off from the left until the rest is a
node again. Counting the pops and following the links gives the number of greedy longest-match pieces of a word in
time linear in its bytes, without building a piece. A word is a run of letters and digits or a run of other
characters than white space; equal words are counted once a task and looked up afterwards.

The vocabulary is a byte-level one, so every byte is a token and no text lacks pieces. Null and empty texts have none.
Each row is counted by itself, repeated ones too; an empty table gives no rows. The time is linear in a text of any length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT_WORD
from .packing import _byte_of_char, default_tokenizer

_WORD = re.compile(r"\w+|[^\w\s]+")
#: Words whose count is kept; past it the table starts anew.
CACHE = 150_000


class LongestMatch:
    """goto: node*256+byte -> node; fail, popped: by node. Node 0 is the root."""

    def __init__(self, tokens: list[bytes]):
        self.goto: dict[int, int] = {}
        final = [False]
        for token in tokens:
            node = 0
            for byte in token:
                nxt = self.goto.get(node << 8 | byte)
                if nxt is None:
                    nxt = len(final)
                    final.append(False)
                    self.goto[node << 8 | byte] = nxt
                node = nxt
            final[node] = node != 0
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        edges: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.goto.items():
            edges.setdefault(key >> 8, []).append((key & 255, node))
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in edges.get(node, ()):
                if final[child]:
                    self.fail[child], self.popped[child] = 0, 1
                else:  # pop what the parent pops, until the byte continues what is left
                    z, pops = self.fail[node], self.popped[node]
                    while z >= 0 and (z << 8 | byte) not in self.goto:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[child], self.popped[child] = self.goto[z << 8 | byte], pops
                queue.append(child)

    def count(self, word: bytes) -> int:
        goto, fail, popped = self.goto, self.fail, self.popped
        node = n = 0
        for byte in word:
            nxt = goto.get(node << 8 | byte)
            while nxt is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    raise ValueError("the vocabulary lacks a byte")
                nxt = goto.get(node << 8 | byte)
            node = nxt
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n


class _Counts(dict):
    def __init__(self, match: LongestMatch):
        self.match = match

    def __missing__(self, word: str) -> int:
        n = self.match.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= KEPT_WORD:
            if len(self) > CACHE:
                self.clear()
            self[word] = n
        return n


_counts: dict[str, _Counts] = {}


def vocabulary(path: str | None = None) -> list[bytes]:
    """The tokens of a byte-level vocabulary file as bytes, without its special ones; all single bytes are in it."""
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        model = json.load(f)
    byte, special = _byte_of_char(), {t["content"] for t in model.get("added_tokens", [])}
    found = {bytes(byte[c] for c in t) for t in model["model"]["vocab"] if t not in special}
    return sorted(found | {bytes([b]) for b in range(256)})


def count_tokens(docs: DataFrame, tokens: list[bytes] | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_words long, n_tokens long, n_bytes long for every row; no shuffle."""
    tokens = tokens or vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    key = hashlib.sha256(b"".join(len(t).to_bytes(4, "little") + t for t in tokens)).hexdigest()

    def run(batches):
        tokens = shared.value
        if key not in _counts:
            _counts.clear()  # a worker keeps one automaton
            _counts[key] = _Counts(LongestMatch(tokens))
        counts = _counts[key]
        for batch in batches:
            words, total = [], []
            for t in batch.column(1):
                found = _WORD.findall(t.as_py() or "")
                words.append(len(found))
                total.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(total, pa.int64()), batch.column(2)],
                                             names=["doc_id", "n_words", "n_tokens", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, n_bytes long")
