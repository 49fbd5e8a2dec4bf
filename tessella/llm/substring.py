"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents.

The reference is every document, indexed in blocks: an anchor is the smallest hash of the phrases of
PHRASE words inside a window of `width` words, so that two equal windows have equal anchors, and the
index is a table of anchors dealt over Spark's partitions (its blocks). A document is parsed only where
its anchors stand in a second document: there its windows are looked up in the index, by their hash, for the first
document that holds them and where. Parsing goes from left to right: a factor is copied from its source as far as the windows of
the two go on alike, and at its end the next window is looked up anew. Factors are `width` words long or longer, and
their words are a duplicate span. Which of several sources is taken changes the factors, but not the words that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned, release

PHRASE = 6
#: More shared anchors than this are joined instead of broadcast as a bit filter.
MAX_FILTERED = 24_000_000
#: Documents are hashed together up to about so many words.
CHUNK_WORDS = 150_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """63-bit hashes of words, remembered up to a limit."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word) >> 1
        if len(self) < self.LIMIT:
            self[word] = value
        return value


HASHES = WordHashes()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A mixed 64-bit hash of every n consecutive word hashes."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = out * FACTOR + h[i : i + len(out)]
    out ^= out >> np.uint64(32)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


class Chunk:
    """The windows of some documents: row (which document), start (word in it), hash and anchor of each."""

    def __init__(self, docs: list[list[bytes]], width: int):
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        h = np.fromiter((HASHES[w] for words in docs for w in words), np.uint64, int(sizes.sum()))
        row = np.repeat(np.arange(len(docs)), sizes)
        start = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fits = np.flatnonzero(start + width <= np.repeat(sizes, sizes))
        self.row, self.start = row[fits], start[fits]
        if len(fits):
            self.anchor = sliding_min(rolled(h, PHRASE), width - PHRASE + 1)[fits]
            self.hashes = rolled(h, width)[fits]
        else:
            self.anchor = self.hashes = np.zeros(0, np.uint64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with their words (column text), of about CHUNK_WORDS words each."""
    for batch in batches:
        docs, first, count = [], 0, 0
        for i, text in enumerate(batch.column("text")):
            docs.append(split(text.as_py()))
            count += len(docs[-1])
            if count >= CHUNK_WORDS or i + 1 == batch.num_rows:
                yield batch.slice(first, i + 1 - first), docs
                docs, first, count = [], i + 1, 0


def anchors(rows: DataFrame, width: int) -> DataFrame:
    """ident, anchor: the anchors of each document of rows (ident, text)."""
    kind = rows.schema["ident"].dataType.simpleString()

    def run(batches):
        for batch, docs in chunks(batches):
            c = Chunk(docs, width)
            if len(c.row):
                new = np.concatenate([[True], (c.anchor[1:] != c.anchor[:-1]) | (c.row[1:] != c.row[:-1])])
                yield pa.RecordBatch.from_arrays([batch.column("ident").take(pa.array(c.row[new])), pa.array(c.anchor[new].view(np.int64))], names=["ident", "anchor"])

    return rows.mapInArrow(run, f"ident {kind}, anchor bigint")


class BitFilter:
    """A Bloom filter of fixed size over anchors, which are hashes themselves: it passes all that were added and few others."""

    BITS = 27

    def __init__(self, words: np.ndarray, masks: np.ndarray):
        self.bits = np.zeros(1 << (self.BITS - 6), np.uint64)
        self.bits[words] = masks.view(np.uint64)

    @classmethod
    def of(cls, anchors: DataFrame) -> BitFilter:
        """Built from bits that Spark has put together word by word; the driver gets its fixed size at most."""
        slots = F.explode(F.array(*[F.shiftrightunsigned("anchor", by).bitwiseAND(F.lit((1 << cls.BITS) - 1)) for by in (0, 64 - cls.BITS)])).alias("slot")
        words = anchors.select(slots).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask")).toArrow()
        return cls(words.column("word").to_numpy(), words.column("mask").to_numpy())

    def passes(self, anchors: np.ndarray) -> np.ndarray:
        ok = np.ones(len(anchors), bool)
        for slot in (anchors & np.uint64((1 << self.BITS) - 1), anchors >> np.uint64(64 - self.BITS)):
            ok &= (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok


def listed(batch: pa.RecordBatch, c: Chunk) -> np.ndarray:
    """Which windows have an anchor that the column `shared` lists for their document."""
    shared = batch.column("shared")
    lists = shared.flatten().to_numpy().view(np.uint64)
    owner = np.repeat(np.arange(batch.num_rows), shared.value_lengths().fill_null(0).to_numpy())
    values, at = np.unique(lists, return_inverse=True)
    pairs = np.unique(owner * len(values) + at)
    if not len(c.row) or not len(values):
        return np.zeros(len(c.row), bool)
    place = np.minimum(np.searchsorted(values, c.anchor), len(values) - 1)
    wanted = c.row * len(values) + place
    found = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
    return (values[place] == c.anchor) & (pairs[found] == wanted)


def windows(rows: DataFrame, width: int, bits=None) -> DataFrame:
    """ident, start, hash of the windows whose anchor passes the broadcast filter, or is listed in the column `shared`."""
    kind = rows.schema["ident"].dataType.simpleString()

    def run(batches):
        for batch, docs in chunks(batches):
            c = Chunk(docs, width)
            ok = listed(batch, c) if bits is None else bits.value.passes(c.anchor)
            yield pa.RecordBatch.from_arrays([batch.column("ident").take(pa.array(c.row[ok])), pa.array(c.start[ok], pa.int32()), pa.array(c.hashes[ok].view(np.int64))], names=["ident", "start", "hash"])

    return rows.mapInArrow(run, f"ident {kind}, start int, hash bigint")


def parsed(start: np.ndarray, source: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors over the windows of a document that the index holds, as (place of the first window, end word).

    source and at say where the index has each window: a factor starts at the first window that is left and is
    copied from there as far as the next window is also the next one of that source. At its end, the next window is looked up
    anew, so that nothing is lost where the source changes.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    goes_on = (start[1:] == start[:-1] + 1) & (source[1:] == source[:-1]) & (at[1:] == at[:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    last = np.concatenate([first[1:] - 1, [len(start) - 1]])
    return first, start[last] + width


def united(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Spans in order of start, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in zip(starts, ends):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def duplicate_windows(rows: DataFrame, width: int) -> DataFrame:
    """ident and factors (array of start, end, source, at) over the windows of a document that one with a smaller ident holds; the first of those is the source, which has it at `at`.

    Windows become factors as soon as those of a document meet, so that no window is written to the shared folder.

    Up to MAX_FILTERED shared anchors, a bit filter of them goes to all executors and picks the windows while the
    texts are read. Beyond that a filter of bounded size would pass too much: then each document is joined with its own shared anchors.
    """
    spark = rows.sparkSession
    spans = F.min("ident").alias("first"), F.max("ident").alias("last")
    shared = pinned(anchors(rows, width).groupBy("anchor").agg(*spans).where("first < last").select("anchor"))
    release(spark)
    if shared.count() <= MAX_FILTERED:
        picked = windows(rows, width, spark.sparkContext.broadcast(BitFilter.of(shared)))
    else:
        wanted = pinned(anchors(rows, width).join(shared, "anchor").groupBy("ident").agg(F.collect_set("anchor").alias("shared")))
        picked = windows(rows.join(wanted, "ident"), width)
    firsts = pinned(picked.groupBy("hash").agg(*spans, F.min_by("start", "ident").alias("at")).where("first < last").select("hash", "first", "at"))
    release(spark)
    found = picked.join(firsts, "hash").where("first < ident").select("ident", "start", F.col("first").alias("source"), "at")
    out = pinned(factors(found, width))
    release(spark)
    return out


def factors(found: DataFrame, width: int) -> DataFrame:
    """ident and factors (start and end in words, source, at, in order of start) of the windows found (ident, start, source, at), a task's documents one after the other."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(parts, "ident").sortWithinPartitions("ident", "start", "source", "at")
    kind = found.schema["ident"].dataType.simpleString()

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            code = table.column("ident").combine_chunks().dictionary_encode().indices.to_numpy()
            # The last document may go on in the next batch.
            cut = int(np.searchsorted(code, code[-1])) if len(code) else 0
            yield from emit(table.slice(0, cut), code[:cut])
            held = table.slice(cut)
        if held is not None:
            yield from emit(held, held.column("ident").combine_chunks().dictionary_encode().indices.to_numpy())

    def emit(table, code):
        if not len(table):
            return
        start, at = (table.column(c).to_numpy().astype(np.int64) for c in ("start", "at"))
        source = table.column("source").combine_chunks()
        origin = source.dictionary_encode().indices.to_numpy()
        # The same window of rows that repeat an ident counts once.
        once = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (start[1:] != start[:-1]) | (origin[1:] != origin[:-1]) | (at[1:] != at[:-1])]))
        code, start, at, origin = code[once], start[once], at[once], origin[once]
        edges = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
        picks, ends = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            first, end = parsed(start[a:b], origin[a:b], at[a:b], width)
            picks.append(first + a)
            ends.append(end)
        pick = np.concatenate(picks)
        each = pa.StructArray.from_arrays([pa.array(start[pick]), pa.array(np.concatenate(ends)), source.take(pa.array(once[pick])), pa.array(at[pick])], names=["start", "end", "source", "at"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, picks)]), pa.int32()), each)
        yield pa.RecordBatch.from_arrays([table.column("ident").combine_chunks().take(pa.array(once[edges[:-1]])), lists], names=["ident", "factors"])

    return dealt.mapInArrow(run, f"ident {kind}, factors array<struct<start: bigint, end: bigint, source: {kind}, at: bigint>>")


def deduped(docs: DataFrame, width: int = 13, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, n_words, factors (start and end in words, source, at), removed (their spans, united), kept (the other words joined by a blank) of every document.

    A word goes if it is in a window of `width` words that starts in a document with a smaller ident as well;
    windows are those of the input. Null texts have no words; null idents are compared with nothing; rows
    that repeat an ident do not count against each other. Windows are compared by 64-bit hashes.
    """
    rows = docs.select(docs[ident].alias("ident"), docs[text].alias("text"))
    found = duplicate_windows(rows.where("ident is not null"), width)
    joined = rows.join(found.withColumnRenamed("ident", "of"), F.col("ident") == F.col("of"), "left").select("ident", "text", F.coalesce("factors", F.array().cast(found.schema["factors"].dataType)).alias("factors"))
    kind = rows.schema["ident"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, docs in chunks(batches):
            lists = batch.column("factors")
            each = lists.flatten()
            start, end = (each.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            edges = np.cumsum([0, *lists.value_lengths().to_numpy(zero_copy_only=False)])
            removed, kept = [], []
            for words, a, b in zip(docs, edges[:-1].tolist(), edges[1:].tolist()):
                spans = united(start[a:b].tolist(), end[a:b].tolist())
                cuts = [0, *(x for s in spans for x in s), len(words)]
                kept.append(b" ".join(w for i, j in zip(cuts[::2], cuts[1::2]) for w in words[i:j]).decode())
                removed.append([{"start": i, "end": j} for i, j in spans])
            yield pa.RecordBatch.from_arrays([batch.column("ident"), pa.array([len(x) for x in docs], pa.int64()), lists, pa.array(removed, span), pa.array(kept)], names=["ident", "n_words", "factors", "removed", "kept"])

    return joined.mapInArrow(run, f"ident {kind}, n_words bigint, factors array<struct<start: bigint, end: bigint, source: {kind}, at: bigint>>, removed array<struct<start: bigint, end: bigint>>, kept string")
