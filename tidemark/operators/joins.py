"""As-of joins, session calendar, incremental keys, dictionary tags."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.lineage import bounded_broadcast, checkpointed  # noqa: F401 (tests replace the first)

#: Aliases of one regular expression.
MOST_ALIASES = 5000
#: Different numbers of words that the aliases of a dictionary may have.
MOST_LENGTHS = 32


def asof_backward(probes: DataFrame, rows: DataFrame, value: list[str], tolerance_days: int = 5) -> DataFrame:
    """For each probe (symbol, date) the newest row at or before it, at most tolerance_days old: value columns and source_date.

    Union and window instead of a range join: one shuffle on symbol. A probe stands after the rows of its day; of several rows
    a day the last by value wins. Probes without a match keep nulls."""
    left = probes.select("symbol", "date", F.lit(1).alias("_p"), F.lit(None).cast(rows.select(F.struct("date", *value)).schema[0].dataType).alias("_v"))
    right = rows.select("symbol", "date", F.lit(0).alias("_p"), F.struct("date", *value).alias("_v"))
    w = Window.partitionBy("symbol").orderBy("date", "_p", "_v").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_p = 1")
    ok = F.datediff("date", "_v.date") <= tolerance_days
    return found.select("symbol", "date", F.when(ok, F.col("_v.date")).alias("source_date"), *[F.when(ok, F.col(f"_v.{c}")).alias(c) for c in value])


def asof_forward(probes: DataFrame, rows: DataFrame, value: list[str], max_days: int = 7) -> DataFrame:
    """The first row strictly after each probe's date, at most max_days later."""
    left = probes.select("symbol", "date", F.lit(0).alias("_p"), F.lit(None).cast(rows.select(F.struct("date", *value)).schema[0].dataType).alias("_v"))
    right = rows.select("symbol", "date", F.lit(-1).alias("_p"), F.struct("date", *value).alias("_v"))
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc(), F.col("_p").desc(), F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_p = 0")
    ok = F.datediff("_v.date", "date") <= max_days
    return found.select("symbol", "date", F.when(ok, F.col("_v.date")).alias("source_date"), *[F.when(ok, F.col(f"_v.{c}")).alias(c) for c in value])


def assign_session_date(items: DataFrame, sessions: DataFrame, ts: str = "published_at", close: str = "15:30:00") -> DataFrame:
    """items plus trading_date: the local day if it is a session and local time is up to the close, else the next session.

    The calendar is one row a day (a few thousand), so it is broadcast."""
    span = sessions.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day")).join(sessions.select(F.col("session_date").alias("day"), F.col("session_date").alias("s")), "day", "left")
    after = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    calendar = days.select("day", "s", F.first("s", ignorenulls=True).over(after).alias("next"))
    local = F.col(ts) + F.expr("INTERVAL '05:30' HOUR TO MINUTE")
    joined = items.withColumn("_day", F.to_date(local)).join(F.broadcast(calendar), F.col("_day") == F.col("day"), "left")
    same = F.col("s").isNotNull() & (F.date_format(local, "HH:mm:ss") <= close)
    return joined.withColumn("trading_date", F.when(same, F.col("s")).otherwise(F.col("next"))).drop("_day", "day", "s", "next")


def symbol_date_grid(symbols: DataFrame, first: str, final: str) -> DataFrame:
    days = symbols.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(final).cast("date"))).alias("date"))
    return symbols.select("symbol").distinct().crossJoin(F.broadcast(days))  # days: as many as the range has


def only_missing(wanted: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    return wanted if force else wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def keep_existing(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(known.select(*keys).distinct(), keys, "left_semi")


def tag_pattern(aliases: list[str]) -> str:
    """Alternation of the aliases, longest first, at word borders: leftmost-longest matching."""
    ordered = sorted({a.lower() for a in aliases}, key=lambda a: (-len(a), a))
    escaped = ["".join(c if c.isalnum() or c in " _" else "\\" + c for c in a) for a in ordered]
    return "(?<![a-z0-9_])(" + "|".join(escaped) + ")(?![a-z0-9_])"


def tag_symbols(articles: DataFrame, aliases: list[tuple[str, str]], text: Column) -> DataFrame:
    """(article_id, symbol, match_keyword): one row per symbol found, its first match kept. For dictionaries of a few hundred aliases, since the
    expression tries each at every place; tag_dictionary takes any number."""
    if len(aliases) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases: use tag_dictionary")
    spark = articles.sparkSession
    table = spark.createDataFrame([(a.lower(), s) for a, s in aliases], "keyword string, symbol string")
    hits = articles.select("article_id", F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(tag_pattern([a for a, _ in aliases])), F.lit(1))).alias("pos", "keyword"))
    found = hits.join(F.broadcast(table), "keyword")
    return found.groupBy("article_id", "symbol").agg(F.min_by("keyword", "pos").alias("match_keyword"))


#: Word characters of aliases and texts, lower-cased: the borders at which an alias may begin and end.
WORD = "[a-z0-9_]+"


#: Bits of the bitmap of an alias's words by hash, of which there are 16 a row at least up to MOST_BITS: of a dictionary of any size so much
#: reaches the driver and the tasks.
BITS, MOST_BITS = 1 << 22, 1 << 28
#: Rows of one Arrow batch that a task hands on.
RUN_ROWS = 20_000
#: Bytes of a dictionary that each task may hold. Of a larger one each group of texts gets what may stand in it.
HELD_BYTES = 128 << 20
#: Bytes of text in such a group, besides the longest text.
GROUP_BYTES = 32 << 20
#: Bytes of text that a task looks through at a time, besides the longest text, and pairs of article and symbol that it then holds.
PIECE = 1 << 20
#: Whether a byte is a word character.
_IS_WORD = np.array([re.fullmatch(WORD.encode(), bytes([c])) is not None for c in range(256)])


def _bits(rows: int) -> int:
    return min(max(BITS, 1 << (16 * rows).bit_length()), MOST_BITS)


def _bitmap(table: DataFrame, bits: int = BITS) -> bytes:
    """One bit for each hash of a core that stands in table, at most bits / 64 rows on the driver."""
    at = table.select((F.crc32("core") % bits).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def _grams(lengths: list[int], bitmap: Broadcast):
    """From (key, text): the hashes of the runs of n words for each n that may be an alias's by the bitmap. Rows are handed on in batches of
    RUN_ROWS, whatever texts hold."""
    word = re.compile(WORD.encode())

    def run(batches):
        bits, hashes, whose = bitmap.value, [], []
        last = len(bits) * 8 - 1

        def taken(keys):
            out = pa.RecordBatch.from_arrays([keys.take(pa.array(whose, pa.int64())), pa.array(hashes, pa.int64())], names=[names[0], "hash"])
            hashes.clear()
            whose.clear()
            return out

        for batch in batches:
            keys, names = batch.column(0), batch.schema.names
            for row, value in enumerate(batch.column(1).cast(pa.large_binary())):
                text = value.as_py() or b""
                at = [m.span() for m in word.finditer(text)]
                for i, (begin, _) in enumerate(at):
                    for n in lengths:
                        if i + n > len(at):
                            break
                        hashed = crc32(text[begin : at[i + n - 1][1]])
                        p = hashed & last
                        if bits[p >> 3] >> (p & 7) & 1:
                            hashes.append(hashed)
                            whose.append(row)
                    if len(hashes) >= RUN_ROWS:
                        yield taken(keys)
            yield taken(keys)

    return run


def _leftmost(batches):
    """From (article_id, keyword, begin, size), an article's rows together, leftmost first and of these the longest: the first of each keyword
    among the hits that don't overlap. Across batches only the last hit's end and the article's keywords are kept."""
    whose, end, seen = object(), -1, set()
    for batch in batches:
        kept = []
        for i, (key, keyword, begin, size) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if key != whose:
                whose, end, seen = key, -1, set()
            if begin >= end:
                end = begin + size
                if keyword not in seen:
                    seen.add(keyword)
                    kept.append(i)
        yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in batch.columns[:3]], names=["article_id", "keyword", "pos"])


def _held(table: pa.Table) -> dict:
    """What a task holds of a dictionary (hash, lead, keyword, symbols): its rows by hash, their symbols from `until` on as `codes` of `names`,
    and a bitmap of the hashes."""
    rows = table.select(["hash", "lead", "keyword", "symbols"]).sort_by("hash")
    hashes = rows["hash"].to_numpy().astype(np.uint32)
    symbols = rows["symbols"].combine_chunks()
    names = symbols.flatten().cast(pa.string()).dictionary_encode()
    bits = np.zeros(_bits(len(hashes)), bool)
    bits[hashes & np.uint32(len(bits) - 1)] = True
    return {"hash": hashes, "lead": rows["lead"].to_numpy().astype(np.int32), "words": rows["keyword"].cast(pa.binary()).combine_chunks(),
            "until": np.concatenate([[0], np.cumsum(symbols.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32),
            "codes": names.indices.to_numpy(), "names": names.dictionary, "bits": np.packbits(bits, bitorder="little")}


def _ranges(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges of so many numbers, from first on: to which each number belongs, and the numbers."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) + np.repeat(first - np.cumsum(counts) + counts, counts)


def _hits(data: bytes, lengths: list[int], held: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, row of the dictionary) of the runs of n words that are an alias's and stand in data between other characters, leftmost
    first and of these the longest. Runs are found by their hash and compared; data begins and ends with another character."""
    word = _IS_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    found, last = [np.zeros((3, 0), np.int64)], np.uint32(len(held["bits"]) * 8 - 1)
    for n in lengths:
        for i in range(0, len(begins) - n + 1, RUN_ROWS):
            begin = begins[i : min(i + RUN_ROWS, len(begins) - n + 1)]
            end = ends[i + n - 1 : i + n - 1 + len(begin)]
            hashes = np.fromiter((crc32(data[b:e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)), np.uint32, len(begin))
            p = hashes & last
            maybe = (held["bits"][p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            begin, hashes = begin[maybe], hashes[maybe]
            first = np.searchsorted(held["hash"], hashes)
            which, row = _ranges(first, np.searchsorted(held["hash"], hashes, "right") - first)
            words = held["words"].take(pa.array(row))
            begin = begin[which] - held["lead"][row]
            end = begin + pc.binary_length(words).to_numpy(zero_copy_only=False)
            inside = (begin > 0) & (end < len(data))
            # the regular expression's borders: no word character beyond the alias's own outer characters
            inside[inside] = ~word[begin[inside] - 1] & ~word[end[inside]]
            inside &= np.array([data[b:e] == w for b, e, w in zip(begin.tolist(), end.tolist(), words.to_pylist(), strict=True)], bool)
            found.append(np.stack([begin, end, row])[:, inside])
    begin, end, row = np.concatenate(found, axis=1)
    order = np.lexsort((-end, begin))
    return begin[order], end[order], row[order]


def _tagged(batches, lengths: list[int], held: dict):
    """From batches of (article_id, text) those of (article_id, symbol, match_keyword, pos), an article's symbol with its first keyword. Texts are
    looked through in pieces of about PIECE bytes; only what is kept is handed on."""
    for batch in batches:
        column = batch.column(1).cast(pa.large_binary())
        pieces = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(column)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            texts = column.slice(low, high - low).to_pylist()
            stops = np.cumsum([len(t) + 1 for t in texts])
            starts = np.concatenate([[0], stops])[:-1] + 1
            begin, end, row = _hits(b"\n" + b"\n".join(texts) + b"\n", lengths, held)
            whose = np.searchsorted(starts, begin, "right") - 1
            within = end <= stops[whose]  # not across texts
            hits = pa.RecordBatch.from_arrays([pa.array(c[within]) for c in (whose, row, begin, end - begin)], names=["whose", "row", "begin", "size"])
            kept = list(_leftmost(hits.slice(i, RUN_ROWS) for i in range(0, max(1, hits.num_rows), RUN_ROWS)))
            whose, row, begin = (np.concatenate([b.column(i).to_numpy() for b in kept]) for i in range(3))
            first, counts = held["until"][row], held["until"][row + 1] - held["until"][row]
            shares = np.flatnonzero(np.diff(np.cumsum(counts, dtype=np.int64) // PIECE)) + 1
            for share in np.split(np.arange(len(row)), shares):
                which, at = _ranges(first[share], counts[share])
                which, codes = share[which], held["codes"][at].astype(np.int64)
                # a text's symbol once, with its first keyword
                only = np.sort(np.unique(whose[which] * len(held["names"]) + codes, return_index=True)[1])
                for i in range(0, len(only), RUN_ROWS):
                    of, code = which[only[i : i + RUN_ROWS]], codes[only[i : i + RUN_ROWS]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(low + whose[of])), held["names"].take(pa.array(code)), held["words"].take(pa.array(row[of])).view(pa.string()),
                         pa.array(begin[of] - starts[whose[of]], pa.int32())], names=["article_id", "symbol", "match_keyword", "pos"])


def _tags(lengths: list[int], held: Broadcast):
    """_tagged by a dictionary that each task holds."""
    return lambda batches: _tagged(batches, lengths, held.value)


def _group_tags(lengths: list[int]):
    """_tagged for one group of texts (_g, _t, article_id) and its own dictionary."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        kinds = [texts.schema.field("article_id").type, pa.string(), pa.string(), pa.int32()]
        tags = _tagged(texts.select(["article_id", "_t"]).to_batches(), lengths, _held(words))
        return pa.Table.from_batches(tags, pa.schema(list(zip(["article_id", "symbol", "match_keyword", "pos"], kinds, strict=True))))

    return run


def tag_dictionary(articles: DataFrame, aliases: DataFrame, text: Column) -> DataFrame:
    """(article_id, symbol, match_keyword) as tag_symbols, for a dictionary aliases(alias, symbol) of any size.

    Texts are cut into runs of as many words as aliases have; those that a bitmap of the aliases' hashes doesn't rule out are compared with
    the aliases, so that the work follows the text and not the number of aliases. An alias that begins or ends with other
    characters is found by its words and then checked with these. Of an article's hits those stay that begin leftmost, of these
    the longest, without overlap; they are judged one after the other, where the text is. Up to HELD_BYTES, counted first, each task holds the
    dictionary, and only the tags are shuffled. Of a larger one each group of texts gets the aliases whose hashes stand in it: texts
    are shuffled once, and the hashes and aliases that differ within a group. Aliases without a word character, and null texts, match nothing;
    article_id tells the articles apart."""
    lower = F.lower("alias")
    core = F.regexp_extract(lower, r"(?s)([a-z0-9_](?:.*[a-z0-9_])?)", 1)
    known = aliases.where("alias is not null and symbol is not null").select(lower.alias("keyword"), "symbol", core.alias("core")).where("core != ''")
    lead = F.instr("keyword", F.col("core")) - 1
    pairs = checkpointed(known.distinct())
    # what a row takes in _held: six numbers of 4 bytes and the strings
    space = F.sum(F.octet_length("keyword") + F.octet_length("symbol") + 24).alias("space")
    sizes = pairs.groupBy(F.regexp_count("core", F.lit(WORD)).alias("n")).agg(space, F.count("*").alias("rows")).limit(MOST_LENGTHS + 1).collect()
    lengths = sorted(r["n"] for r in sizes)
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"aliases of more than {MOST_LENGTHS} different numbers of words")
    words = pairs.groupBy("keyword", "core").agg(F.collect_set("symbol").alias("symbols")).select(
        F.crc32("core").alias("hash"), F.octet_length(F.substring("keyword", F.lit(1), lead)).alias("lead"), "keyword", "symbols")
    context, kind = articles.sparkSession.sparkContext, articles.schema["article_id"].dataType.simpleString()
    schema = f"article_id {kind}, symbol string, match_keyword string, pos int"
    texts = articles.select("article_id", F.coalesce(F.lower(text), F.lit("")).alias("_t"))
    if sum(r["space"] for r in sizes) <= HELD_BYTES:
        tags = texts.mapInArrow(_tags(lengths, context.broadcast(_held(words.toArrow()))), schema)
    else:
        bitmap = context.broadcast(_bitmap(pairs, _bits(sum(r["rows"] for r in sizes))))
        groups = 1 + (texts.agg(F.sum(F.octet_length("_t"))).first()[0] or 0) // GROUP_BYTES
        # all columns go on to both readers, so that they share one shuffle
        grouped = texts.select(F.pmod(F.xxhash64("article_id"), F.lit(groups)).cast("int").alias("_g"), "_t", "article_id").repartition("_g")
        asked = grouped.mapInArrow(_grams(lengths, bitmap), "_g int, hash long").distinct()
        tags = grouped.groupBy("_g").cogroup(asked.join(words, "hash").groupBy("_g")).applyInArrow(_group_tags(lengths), schema)
    # dealt by article_id alone, whose repeats compress
    return tags.repartition("article_id").groupBy("article_id", "symbol").agg(F.min_by("match_keyword", "pos").alias("match_keyword"))
