"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TO_LOWER, set_apart

#: bytes.translate table: A-Z to a-z, every other ASCII character but 0-9 and a-z to a blank.
NORMAL = bytes(x if x > 0x7F or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else 0x20 for x in TO_LOWER)
#: A benchmark of more bytes than this is broadcast in slices, with one scan each.
MAX_SLICE_BYTES = 16 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of 0-9, a-z and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of `width` ids."""
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for i in range(width):
        out = out * FACTOR + ids[i : i + len(out)].astype(np.uint64)
    return out


class Index:
    """The windows of some benchmark items: word ids, and by window length the sorted hashes and the exact words."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.grams: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
            size = min(width, len(words))
            for i in range(len(words) - size + 1) if size else ():
                self.grams[size][tuple(words[i : i + size])].add(item)
        self.grams = {n: dict(g) for n, g in self.grams.items()}
        self.hashes = {n: np.unique(np.concatenate([rolled(np.array([self.vocabulary[w] for w in g]), n) for g in grams])) for n, grams in self.grams.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items found. A hash match counts only if the words are equal."""
        hit, found = np.zeros(len(words) + 1, np.int32), set()
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, hashes in self.hashes.items():
            if len(words) < size or known[-1] < size:
                continue
            full = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(full):
                continue
            h = rolled(ids, size)[full]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in full[hashes[at] == h].tolist():
                if items := self.grams[size].get(tuple(words[i : i + size])):
                    hit[i] += 1
                    hit[i + size] -= 1
                    found |= items
        return np.cumsum(hit[:-1]) > 0, found


def slices(benchmark: DataFrame, item: str, text: str, max_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about max_bytes at most, dealt by the hash of the item."""
    rows = benchmark.select(benchmark[item].cast("string").alias("item"), benchmark[text].alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // max_bytes) or 1
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def scanned(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", max_slice_bytes: int = MAX_SLICE_BYTES) -> DataFrame:
    """docs with __n_words, __hits (spans of hit words, start and end) and __items (items found, sorted).

    A window is `width` consecutive words of an item, or all words of a shorter one. Null texts have no
    words; an item without an id counts as the item ''; an empty benchmark hits nothing; repeated rows
    are scanned alike. Benchmarks within max_slice_bytes are broadcast whole; larger ones in slices, each document
    then going through one slice after the other in further passes of the same kind.
    """
    extra = [("__n_words", T.LongType()), ("__hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), ("__items", T.ArrayType(T.StringType()))]
    out = docs
    for k, part in enumerate(slices(benchmark, item, item_text, max_slice_bytes)):
        items = [(r["item"] or "", r["text"]) for r in part.collect()]  # within max_slice_bytes
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, width))
        fields = docs.schema.fields
        schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in extra]])

        def run(batches, shared=shared, names=[f.name for f in fields], first=k == 0):
            index = shared.value
            for batch in batches:
                n, spans, items = [], [], []
                old = [None] * batch.num_rows if first else list(zip(batch.column("__hits").to_pylist(), batch.column("__items").to_pylist()))
                for value, before in zip(batch.column(text).to_pylist(), old):
                    words = words_of(value)
                    hit, found = index.scan(words)
                    if before:
                        for s in before[0]:
                            hit[s["start"] : s["end"]] = True
                        found |= set(before[1])
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    n.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                    items.append(sorted(found))
                columns = [pa.array(x, schema_type) for x, schema_type in zip((n, spans, items), (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, names=[*names, *[x for x, _ in extra]])

        out = out.mapInArrow(run, schema)
    return out


def n_hit() -> Column:
    """Hit words of a scanned document."""
    return F.aggregate("__hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any hit, with their own columns; a null text has none."""
    rows, (text,), back = set_apart(docs, text)
    return back(scanned(rows, benchmark, text=text, **options).where(F.size("__hits") == 0))


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents; in those with hits the text is its other words, normalised and joined by blanks. A null text stays null."""
    plain, (text,), back = set_apart(docs, text)
    rows = scanned(plain, benchmark, text=text, **options)

    @F.pandas_udf("string")
    def cut(values, hits):
        def one(value, spans):
            words = words_of(value)
            gone = {i for s in spans for i in range(s["start"], s["end"])}
            return b" ".join(w for i, w in enumerate(words) if i not in gone).decode("utf-8", "replace")

        return values.combine(hits, one)

    return back(rows.withColumn(text, F.when(F.size("__hits") > 0, cut(rows[text], rows["__hits"])).otherwise(rows[text])))
