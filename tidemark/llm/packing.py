"""Best-fit packing of token sequences by minimum bin slack.

Texts become token ids once; the pieces are written to the shared folder, with each piece's rank among the
pieces of its length in its partition. What remains to decide depends on the lengths alone: the histogram of
lengths (at most `capacity` numbers, whatever the corpus) goes to the driver, which fills bin after bin. For
the longest length left, a bitset subset-sum dynamic program over the lengths still available finds the
fullest combination; it is used as often as the counts allow and removed. Pieces then find their bin by
(length, rank) in the resulting plan. The packing is that of the whole corpus, with no bucket borders.

A null or empty text is its end token alone. Repeated rows are packed each. An empty table packs nothing. A text of any length
is encoded whole; only its ids, not its row, are cut into pieces.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, staged

CAPACITY = 1024
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, row long, rank long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


LONG_RUN = 500
_LONG = re.compile(rf"\s{{{LONG_RUN}}}")


class _Encoder:
    """Text -> its ids as little-endian unsigned 32-bit. Texts are encoded by the rank form of the same vocabulary, which
    gives the same ids several times faster. A text that spells a special token goes to the tokenizer itself, and so does one
    with a run of LONG_RUN blanks, which the rank form can't split, or that it can't encode for another reason."""

    def __init__(self, definition: str):
        import public_tokenizers
        import tiktoken

        self.definition, self.tokenizer = definition, None
        model = json.loads(definition)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if not any(t in text for t in self.special) and not _LONG.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:
                pass  # the splitting pattern gave up; the tokenizer doesn't use it
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.definition)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_encoders: dict[int, _Encoder] = {}


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of at most `capacity` tokens; only longer documents are cut, the first piece takes the rest."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        value = definition.value
        key = hash(value)
        encoder = _encoders.get(key) or _encoders.setdefault(key, _Encoder(value))
        seen: Counter = Counter()
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            cols = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "part", "row", "rank")}
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + last
                n = len(ids) // 4
                at, to, piece = 0, n % capacity or capacity, 0
                while at < n:
                    for k, v in zip(cols, (doc_id, piece, at, to - at, ids[4 * at : 4 * to], part, row, seen[to - at]), strict=True):
                        cols[k].append(v)
                    seen[to - at] += 1
                    at, to, piece, row = to, to + capacity, piece + 1, row + 1
                size += len(ids)
                if size > 16 << 20:
                    yield _batch(cols)
                    cols, size = {k: [] for k in cols}, 0
            yield _batch(cols)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _batch(cols: dict) -> pa.RecordBatch:
    kinds = dict(doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids=pa.binary(), part=pa.int32(), row=pa.int64(), rank=pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in cols.items()], names=list(cols))


def fullest(counts: np.ndarray, room: int, longest: int) -> dict[int, int]:
    """The combination of available lengths (at most `longest` each) with the largest sum within room."""
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in range(min(room, longest), 0, -1):
        left = min(int(counts[length]), room // length)
        take = 1
        while left > 0 and not reach & goal:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, copies in a bin, first bin, offset in the bin), and the number of bins."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used, rows, bins = np.zeros(capacity + 1, dtype=np.int64), [], 0
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return rows, bins
        counts[longest] -= 1
        pattern = fullest(counts, capacity - longest, longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(int(counts[k]) // n for k, n in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.append((length, int(used[length]), n, bins, offset))
            used[length] += n * times
            counts[length] -= n * times
            offset += length * n
        bins += times


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(part, row, sequence_id, offset) for written pieces."""
    by_part = staged(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan_bins(histogram, capacity)
    plan = np.array(sorted(rows) or [(0, 0, 1, 0, 0)], dtype=np.int64)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.select("part", "row", "length", "rank").join(bounded_broadcast(base), ["length", "part"]).select(
        "part", "row", "length", (F.col("rank") + F.col("base")).alias("rank"))

    def find(batches):
        plan = shared.value
        keys = (plan[:, 0] << 44) | plan[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            hit = plan[np.searchsorted(keys, (length << 44) | rank, side="right") - 1] if b.num_rows else plan[:0]
            nth = rank - hit[:, 1]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("row"), pa.array(hit[:, 3] + nth // hit[:, 2]), pa.array(hit[:, 4] + nth % hit[:, 2] * length)],
                                             names=["part", "row", "sequence_id", "offset"])

    return ranked.mapInArrow(find, "part int, row long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces with their ids and places: doc_id, piece, start, length, ids binary, sequence_id, offset."""
    pieces = staged(tokenized_pieces(docs, tokenizer, capacity, end), "pieces", "zstd")
    return pieces.join(place_pieces(pieces, capacity), ["part", "row"]).drop("part", "row", "rank")


def packing_digest(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """pack_documents with the checksum of the ids in their stead, taken before the join so that ids aren't shuffled."""
    pieces = staged(tokenized_pieces(docs, tokenizer, capacity), "pieces", "zstd")
    sums = pieces.select("part", "row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return sums.join(place_pieces(pieces, capacity), ["part", "row"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
