"""Spelling variants: words one edit apart, found by pivotal grams, and the frequent form that each rare one follows.

Pivotal prefix filtering (Deng, Li and Feng, 2014) for one edit and bigrams. A global order ranks bigrams from rare to frequent. The prefix
of a word holds all its bigrams up to the third rarest, ties included, and its pivots are two of these that do not overlap, the
cheapest pair, chosen by dynamic programming over positions. One edit leaves one pivot whole, so of two words one edit apart, the one
whose prefix ends first has a pivot in the other's prefix, at the same place or one further. As a vocabulary has few bigrams, the
index does not hold a pivot alone: what lies on the side without the edit is equal in both words, and so is half of the other
side. Pivots are indexed with that text, once for each side and half, and looked up by the prefixes; every pair found is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, pinned

#: Fixed value: the letters of a run.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A task's counts are handed on after so many different words.
MAX_COUNTED = 400_000
#: Words are indexed together up to so many code points, padding included, and up to so many of their bigrams at a time.
CHUNK_CELLS = 400_000
CHUNK_GRAMS = 50_000
#: Words of more code points stand in the index by a digest; their text is joined to the pairs found. A digest is no word: it has digits.
LONG = 64
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def runs_of(text: str | None) -> Counter:
    """How often each run of letters stands in the text, A-Z lower-cased."""
    return Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).decode("utf-8", "surrogatepass")))


def as_counted(ident: str, run: str, one_in: int) -> str:
    """The run as it is counted in the document `ident`: one in so many pairs loses a code point, chosen by their hash."""
    h = zlib.crc32(f"{ident}:{run}".encode())
    return run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, min_chars: int = 7, one_in: int = 31, least: int = 2, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of min_chars code points and more that occur `least` times or more in all documents."""
    rows = docs.select(docs[f"`{ident}`"].cast("string").alias("ident"), docs[f"`{text}`"].alias("text"))

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column("ident").to_pylist(), batch.column("text")):
                for word, n in runs_of(t.as_py()).items():
                    if len(word) >= min_chars:
                        word = as_counted(i or "", word, one_in)
                        if len(word) >= min_chars:
                            counts[word] += n
                if len(counts) >= MAX_COUNTED:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Grams:
    """The order of bigrams: rank of each by rising frequency, and its frequency. There are at most 90 x 90 of them, the letters of a run squared."""

    def __init__(self, counted: list[tuple[str, int]]):
        order = sorted(counted, key=lambda x: (x[1], x[0]))
        codes = np.array([(ord(g[0]) << 9) | ord(g[1]) for g, _ in order], np.int64)
        self.rank = np.full(1 << 18, len(order), np.int64)
        self.rank[codes] = np.arange(len(order))
        self.cost = np.array([c for _, c in order] + [0], np.int64)


def gram_order(words: DataFrame) -> Grams:
    """The order of the bigrams of distinct words (column word), by the number of their places."""
    places = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    counted = words.where(F.length("word") > 1).select(F.explode(places).alias("gram")).groupBy("gram").count().collect()
    return Grams([(r["gram"], r["count"]) for r in counted])


class Block:
    """Some words as a matrix of code points, with the hashes of all their parts."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.size.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        inside = np.arange(width) < self.size[:, None]
        self.chars = np.zeros((len(words), width), np.int64)
        self.chars[inside] = flat
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(width, FACTOR)]))
        self.upto = np.zeros((len(words), width + 1), np.uint64)
        for i in range(width):
            self.upto[:, i + 1] = self.upto[:, i] * FACTOR + self.chars[:, i].astype(np.uint64) + np.uint64(1)

    def part(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each word[start:end]."""
        return self.upto[row, end] - self.upto[row, start] * self.power[end - start]

    def prefixes(self, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank of the last bigram of each prefix; a matrix of the places in it; the places of the two pivots."""
        rank = grams.rank[(self.chars[:, :-1] << 9) | self.chars[:, 1:]]
        none = len(grams.cost) - 1
        rank[np.arange(rank.shape[1]) >= (self.size - 1)[:, None]] = none
        last = np.partition(rank, 2, axis=1)[:, 2]
        inside = (rank <= last[:, None]) & (rank < none)
        # least[j]: the cheapest bigram of the prefix up to place j, and where it stands; a pair is that up to j - 2 and the one at j.
        cost = np.where(inside, grams.cost[rank], np.iinfo(np.int64).max // 4)
        least, at = cost.copy(), np.tile(np.arange(cost.shape[1]), (len(cost), 1))
        for j in range(1, cost.shape[1]):
            keep = least[:, j - 1] <= least[:, j]
            least[keep, j], at[keep, j] = least[keep, j - 1], at[keep, j - 1]
        pair = cost[:, 2:] + least[:, :-2]
        second = pair.argmin(axis=1)
        return last, inside, np.stack([at[np.arange(len(at)), second], second + 2], axis=1)

    def keys(self, row: np.ndarray, place: np.ndarray, more: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of what can be equal in another word, for bigrams at places of words.

        more is None for pivots; for prefixes it is by how many code points the word is longer than the one whose pivot it looks for,
        and parts are those of that word.
        """
        own, d = self.size[row], more or 0
        size = own - d
        out_row, out_key = [], []

        def emit(kind: int, pick: np.ndarray, i: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """The word up to `left` and its last `right` code points are equal."""
            r, i, left, right = row[pick], i[pick], left[pick], right[pick]
            zero = np.zeros_like(left)
            key = self.part(r, zero, left) * MIX + self.part(r, own[pick] - right, own[pick])
            key = (key ^ (key >> np.uint64(31))) * FACTOR + ((size[pick] << 20) ^ (i << 3) ^ kind).astype(np.uint64)
            out_row.append(r)
            out_key.append((key ^ (key >> np.uint64(29))) * MIX)

        # The edit is behind the bigram: all up to it is equal, and the first or second half of the rest.
        rest = size - place - 2
        half = rest // 2
        may = (rest + d >= 0) & ((rest > 0) | (d > 0) | (more is None))
        zero = np.zeros_like(rest)
        emit(1, may, place, place + 2 + half, zero)
        emit(2, may & (half > 0), place, place + 2, rest - half)
        # The edit is before it: all from it on is equal, and the first or second half of what goes before.
        before = place - d
        half = before // 2
        may = (before >= 0) & ((before > 0) | (d > 0) | (more is None))
        emit(3, may, before, half, size - before)
        emit(4, may & (half > 0), before, zero, size - half)
        return np.concatenate(out_row), np.concatenate(out_key)


def blocks(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of similar length, in blocks of about CHUNK_CELLS cells."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    first = 0
    while first < len(order):
        end = max(first + 1, min(len(order), first + CHUNK_CELLS // int(size[order[first]] + 1)))
        while end > first + 1 and size[order[end - 1]] * (end - first) > 2 * CHUNK_CELLS:
            end = first + max(1, (end - first) // 2)
        yield order[first:end]
        first = end


def shown_as(word: str) -> str:
    return word if len(word) <= LONG else f"{xxhash.xxh3_128_hexdigest(word.encode())}:{len(word)}"


def indexed(words: DataFrame, grams: Grams, pivots: bool) -> DataFrame:
    """key, word (or its digest), n, last of each pivot, or of each bigram of a prefix, of the words (word, n); words have three bigrams at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("word").to_pylist()
            for take in blocks(text) if text else ():
                block = Block([text[i] for i in take])
                last, inside, pair = block.prefixes(grams)
                row, place = (np.repeat(np.arange(len(take)), 2), pair.ravel()) if pivots else np.nonzero(inside)
                shown = pa.array([shown_as(text[i]) for i in take], pa.string())
                n = batch.column("n").take(pa.array(take))
                for first in range(0, len(row), CHUNK_GRAMS):
                    cut = slice(first, first + CHUNK_GRAMS)
                    found = [block.keys(row[cut], place[cut], d) for d in ((None,) if pivots else (-1, 0, 1))]
                    at, key = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), shown.take(pa.array(at)), n.take(pa.array(at)), pa.array(last[at].astype(np.int32))], names=["key", "word", "n", "last"])

    return words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint, last int")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: every word (word, n) with each word that differs from it in one code point inserted, deleted or replaced.

    Words need four code points or more, so that a prefix has two bigrams that do not overlap.
    """
    grams = gram_order(words)
    a = indexed(words, grams, pivots=True).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"))
    b = indexed(words, grams, pivots=False).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"))
    found = a.join(b, "key").where("a_last <= b_last AND a <> b")
    digests = F.contains("a", F.lit(":")) | F.contains("b", F.lit(":"))
    once = ordered(found.where(~digests).where(F.levenshtein("a", "b", 1) == 1))
    long = pinned(words.where(F.length("word") > LONG))
    if not long.isEmpty():
        digest = F.udf(shown_as, "string")
        texts = long.select(digest("word").alias("digest"), F.col("word").alias("text"))
        pairs = pinned(ordered(found.where(digests)))
        for side in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("digest").alias(side), F.col("text").alias(f"{side}_text")), side, "left").withColumn(side, F.coalesce(f"{side}_text", side)).drop(f"{side}_text")
        once = once.unionByName(ordered(pairs.where(F.levenshtein("a", "b", 1) == 1)))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return once.select(both.alias("x")).select("x.*")


def ordered(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b, a_n, b_n) once, the smaller word first."""
    swapped = F.col("a") > F.col("b")
    ends = lambda x, y, name: F.when(swapped, F.col(y)).otherwise(F.col(x)).alias(name)
    return pairs.select(ends("a", "b", "a"), ends("b", "a", "b"), ends("a_n", "b_n", "a_n"), ends("b_n", "a_n", "b_n")).distinct()


def variants(docs: DataFrame, min_chars: int = 7, times: int = 10, one_in: int = 31, least: int = 2, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the documents, as `word_counts` counts them.

    form is the near word of largest n (ties: the smallest in code-point order) if that is at least `times` n, else null, and root
    the last word that forms lead to. Null and empty texts have no words, a null ident is written as nothing before the colon, repeated rows count
    as often as they come, and an empty table gives an empty table. min_chars is 4 at least.
    """
    if min_chars < 4 or times < 2:
        raise ValueError("min_chars must be 4 or more, and times 2 or more")
    words = pinned(word_counts(docs, min_chars, one_in, least, ident, text))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    beside = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(beside, "word", "left")
    follows = -F.col("best.less") >= times * F.col("n")
    rows = pinned(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n")))
    return rows.join(roots(rows.where("form IS NOT NULL").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead. Each step doubles how far a word sees; as n grows with every form, none comes back."""
    seen = pinned(forms.select("word", F.col("form").alias("root")))
    while True:
        on = seen.join(seen.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        if on.where("next IS NOT NULL").isEmpty():
            return seen
        seen = pinned(on.select("word", F.coalesce("next", "root").alias("root")))
