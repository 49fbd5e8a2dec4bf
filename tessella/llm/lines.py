"""Line dedup by levelled sorted runs of line hashes, with DataFrame functions only.

The index of line keys is kept as in a log-structured merge tree: each batch of documents is counted
into a sorted run of (key, documents); when a level holds FANOUT runs they are compacted into one of the
next. A new batch is merge-anti-joined with the keys that the runs already know to be frequent, so a
line that is everywhere is no longer carried after the first batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, if_small, pinned, set_apart

FANOUT = 3
#: Batches of a table that is deduped at once: enough for runs of the third level.
BATCHES = FANOUT**2
MAX_BROADCAST_KEYS = 100_000


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hashes(text: Column, min_chars: int) -> Column:
    """The distinct hashes of the keys of a text that have min_chars code points or more."""
    keys = F.filter(F.transform(line_array(text), line_key), lambda k: F.length(k) >= min_chars)
    return F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))


class LineIndex:
    """Levelled runs of (key, n): how many documents hold a line. Every run is sorted by key and kept in the shared folder."""

    def __init__(self, enough: int, fanout: int = FANOUT):
        self.enough, self.fanout, self.levels = enough, fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def merged(self) -> DataFrame | None:
        """All runs as one; the counts of a key add up."""
        frames = self.runs()
        if not frames:
            return None
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.groupBy("key").agg(F.sum("n").alias("n")) if len(frames) > 1 else out

    def frequent(self) -> DataFrame | None:
        rows = self.merged()
        return None if rows is None else rows.where(F.col("n") >= self.enough).select("key")

    def add(self, keys: DataFrame) -> None:
        """Add a batch: a row with a column key for each document and line of it."""
        counted = keys.groupBy("key").agg(F.count("*").alias("n"))
        if (known := self.frequent()) is not None:
            counted = counted.join(known, "key", "left_anti")
        self.levels[0].append(pinned(counted.sortWithinPartitions("key")))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                rows = level[0]
                for f in level[1:]:
                    rows = rows.unionByName(f)
                run = pinned(rows.groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"))
                level.clear()
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(run)


def frequent_lines(hashed: DataFrame, min_docs: int = 10, batches: int = BATCHES) -> DataFrame:
    """The keys that min_docs rows or more of hashed (ident, keys: an array without repeats) hold, by way of a LineIndex fed in batches."""
    index = LineIndex(min_docs)
    for k in range(batches):
        batch = hashed.where(F.pmod(F.xxhash64("ident"), F.lit(batches)) == k)
        index.add(batch.select(F.explode("keys").alias("key")))
    return pinned(index.frequent())


def deduped(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with __n_lines, __n_dropped and __kept (the text of the lines that stay), in place of columns of those names.

    A line goes from every document if its key is long enough and min_docs documents hold it. A null or empty
    text is one empty line. An empty table gives an empty table. Repeated rows are documents of their own. Keys are compared by 64-bit hashes.
    """
    rows, (ident, text), back = set_apart(docs, ident, text)
    hashed = pinned(rows.select(F.col(ident).alias("ident"), key_hashes(F.col(text), min_chars).alias("keys")).where(F.size("keys") > 0))
    frequent = frequent_lines(hashed, min_docs, batches)
    some = if_small(frequent, frequent.count(), MAX_BROADCAST_KEYS)
    hits = hashed.select("ident", F.explode("keys").alias("key")).join(some, "key", "left_semi").groupBy("ident").agg(F.collect_set("key").alias("keys"))
    rows = rows.join(hits, F.col(ident).eqNullSafe(F.col("ident")), "left")
    lines = line_array(F.col(text))
    stays = lambda line: ~(F.array_contains("keys", F.xxhash64(line_key(line))) & (F.length(line_key(line)) >= min_chars))
    rows = rows.withColumn("lines", F.when(F.col("keys").isNull(), lines).otherwise(F.filter(lines, stays)))
    rows = rows.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size("lines")).cast("long"), "kept": F.array_join("lines", "\n")})
    # No lines left at all and one empty line both give the empty text.
    return back(rows, __n_lines="n_lines", __n_dropped="n_dropped", __kept="kept")
