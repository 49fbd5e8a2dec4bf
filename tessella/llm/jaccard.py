"""Exact Jaccard similarity of word shingles for near-duplicates: every link checked, and none missed.

A document is the set of its hashed shingles; equal sets are one node. All sets order their shingles alike, rare ones
first. Two sets of similarity p / q or more then share a shingle among the first n - ceil(n p / q) + 1 of either, so
the pairs that meet at such a shingle hold every link. Only shingles that hold nodes of different groups are looked at. Each
set is first compared with one of those it meets, so that sets that are all alike come together by as many pairs as they are; then pairs that are still
apart are. Parity bitmaps (a shingle flips one bit) differ in no more bits than the sets do in shingles, and two sets that share few
shingles of these prefixes cannot share enough behind them; both drop most other pairs without losing a link. What is
left is compared whole, by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TO_LOWER, if_small, pinned, release, slices

#: 64-bit words of a parity bitmap, slots of the table of frequent shingles, and the documents that it is counted on.
BITS = 16
SLOTS = 20
SAMPLE = 5_000
FEW_TIMES = 8
STEP = 1 << 17
FEW = 1_000_000
#: Pairs of one document that are compared in a task at most, on average.
TOGETHER = 256

NODE = "__row bigint, sig bigint, n int, fp bigint, bits array<bigint>"


# Sets


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes, ascending, of the shingles of `width` lower-cased words; of shorter texts one of all words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity of the shingles on each of 64 * BITS bits."""
    odd = np.bincount((hashes % np.uint64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def behind(n, least: Fraction):
    """Shingles of a set of n that its prefix leaves out."""
    return -(-n * least.numerator // least.denominator) - 1


def prefix(hashes: np.ndarray, often: np.ndarray, least: Fraction) -> np.ndarray:
    """The shingles, rarest first by the table of counts, of which a set of that similarity shares one."""
    n = len(hashes)
    counts = often[(hashes >> np.uint64(64 - SLOTS)).astype(np.int64)]
    return hashes[np.argsort(counts, kind="stable")[: n - behind(n, least) if n else 0]]


def least_shared(n: np.ndarray, m: np.ndarray, least: Fraction) -> np.ndarray:
    """How many shingles the prefixes of linked sets of n and m share at least.

    The sets share p (n + m) / (p + q) or more. What they share up to the end of the prefix that ends first is in both prefixes,
    and the rest is behind the prefix of that set.
    """
    p, q = least.numerator, least.denominator
    return -(-(n + m) * p // (p + q)) - np.maximum(behind(n, least), behind(m, least))


def slot_counts(rows: DataFrame, text: str, width: int) -> np.ndarray:
    """How many documents of a sample have a shingle in each slot, where they are more than FEW_TIMES. It only orders shingles: any table gives the same links."""
    share = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("__row"), F.lit(share)) == 0).select(rows[f"`{text}`"].alias("text"))

    def run(batches):
        for batch in slices(batches):
            every = [shingles(x, width) for x in batch.column("text").to_pylist()]
            at, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]) >> np.uint64(64 - SLOTS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n)], names=["slot", "n"])

    found = sample.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > FEW_TIMES).toArrow()  # a row a slot at most
    often = np.zeros(1 << SLOTS, np.int32)
    often[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 1 << 30)
    return often


def sets(rows: DataFrame, text: str, width: int, least: Fraction, votes: Callable[[np.ndarray], int]) -> DataFrame:
    """__row, sig (a hash of the set), n, fp (votes of its hashes; 0 if it is empty), bits and the prefix of every numbered row."""
    often = rows.sparkSession.sparkContext.broadcast(slot_counts(rows, text, width))

    def run(batches):
        for batch in slices(batches):
            every = [shingles(x, width) for x in batch.column("text").to_pylist()]
            sig = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in every], np.uint64).view(np.int64)
            heads = [prefix(h, often.value, least).view(np.int64) for h in every]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), pa.array(sig), pa.array([len(h) for h in every], pa.int32()), pa.array([votes(h) if len(h) else 0 for h in every], pa.int64()), lists([bitmap(h) for h in every]), lists(heads)],
                names=["__row", "sig", "n", "fp", "bits", "prefix"],
            )

    return rows.select("__row", rows[f"`{text}`"].alias("text")).mapInArrow(run, NODE + ", prefix array<bigint>")


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


# Pairs


def near_pairs(n: np.ndarray, bits: np.ndarray, label: np.ndarray, group: np.ndarray, place: np.ndarray, before: np.ndarray, held: np.ndarray, least: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs inside a group, with different labels, that may have the similarity, some at a time. Rows are sorted by group and label.

    A row is a set that holds the group's shingle at `place` of its prefix, behind `before` others that sets of other labels hold too, of `held`
    in all. So two sets share no more of their prefixes than either holds, and no more altogether than either has before the shingle and
    behind it. Sizes and bitmaps bound what they share as well.
    """
    p, q = least.numerator, least.denominator
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def check(i: np.ndarray, j: np.ndarray) -> None:
        fits = p * np.maximum(n[i], n[j]) <= q * np.minimum(n[i], n[j])
        i, j = i[fits], j[fits]
        fits = least_shared(n[i], n[j], least) <= np.minimum(held[i], held[j])
        i, j = i[fits], j[fits]
        most = np.minimum(before[i], before[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
        fits = most * (p + q) >= (n[i] + n[j]) * p
        i, j = i[fits], j[fits]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        fits = differ * (p + q) <= (n[i] + n[j]) * (q - p)
        if fits.any():
            found.append((i[fits], j[fits]))

    def taken(least_many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if found and sum(len(i) for i, _ in found) >= least_many:
            yield tuple(np.concatenate(x) for x in zip(*found))
            found.clear()

    new = np.concatenate([[True], group[1:] != group[:-1], [True]])
    edges = np.flatnonzero(new)
    sizes = np.diff(edges)
    few = np.flatnonzero(np.repeat(sizes <= 32, sizes))
    for step in range(1, 32):
        i, j = few[:-step], few[step:]
        same = group[i] == group[j]
        if not same.any():
            break
        same &= label[i] != label[j]
        check(i[same], j[same])
        yield from taken(STEP)
    # In large groups the rows of each label meet those of the labels behind it, never each other.
    runs = np.flatnonzero(new | np.concatenate([[True], label[1:] != label[:-1], [True]]))
    end_of = np.repeat(edges[1:], sizes)
    for a, b in zip(runs[:-1].tolist(), runs[1:].tolist()):
        end = int(end_of[a])
        if end - edges[np.searchsorted(edges, a, "right") - 1] <= 32 or b == end:
            continue
        step = max(1, STEP // (end - b))
        for k in range(a, b, step):
            i, j = np.divmod(np.arange((min(k + step, b) - k) * (end - b)), end - b)
            check(k + i, b + j)
            yield from taken(STEP)
    yield from taken(1)


def shared_tokens(every: DataFrame, nodes: DataFrame) -> DataFrame:
    """token, place, sig: the shingles of the prefixes of every (__row, sig, prefix) that two sets hold at least; nodes has one row (__row) of each sig.

    Both shuffles are in proportion to the prefixes, whatever the size of the table; copies are left out first.
    """
    gone = pinned(every.select("__row").join(nodes.select("__row"), "__row", "left_anti"))
    heads = every.select("__row", "sig", "prefix").join(if_small(gone, gone.count(), FEW), "__row", "left_anti")
    often = pinned(heads.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token"))
    release(every.sparkSession)
    return pinned(heads.select(F.posexplode("prefix").alias("place", "token"), "sig").join(often, "token", "left_semi").select("token", "place", "sig"))


def labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """shared (token, place, sig) with the label of each sig; labels (node, label) has those of the sets that have links."""
    return shared.join(if_small(labels, labels.count(), FEW), F.col("sig") == F.col("node"), "left").select("token", "place", "sig", F.coalesce("label", "sig").alias("label"))


def mixed_tokens(rows: DataFrame) -> DataFrame:
    """The tokens of rows (token, label) that sets of different labels hold."""
    return rows.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")


def met(shared: DataFrame, labels: DataFrame, nodes: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """What emit makes of the rows (token, sig, n, bits, label, place, before, held) of whole groups of a token that sets of different labels hold."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = labelled(shared, labels)
    rows = pinned(rows.join(mixed_tokens(rows), "token", "left_semi").select("token", "place", "sig", "label"))
    release(nodes.sparkSession)
    of = Window.partitionBy("sig")
    placed = rows.withColumns({"before": F.row_number().over(of.orderBy("place")) - 1, "held": F.count("*").over(of).cast("int")})
    dealt = placed.join(nodes.select("sig", "n", "bits"), "sig").select("token", "sig", "n", "bits", "label", "place", "before", "held").repartition(parts, "token").sortWithinPartitions("token", "label", "sig")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            token = table.column("token").to_numpy()
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
            yield from emit(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from emit(held)

    return dealt.mapInArrow(run, schema)


def pairs_of(table: pa.Table, least: Fraction) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """sig and n of the rows of some groups, and the places of their near pairs, some at a time."""
    token, sig, label = (table.column(c).to_numpy() for c in ("token", "sig", "label"))
    n, place, before, held = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "place", "before", "held"))
    bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(sig), BITS)
    return sig, n, near_pairs(n, bits, label, token, place, before, held, least)


def first_partners(shared: DataFrame, labels: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """token, place, sig, u: the rows of shared that have a near pair in their group, and u, the smallest sig below theirs of such a pair (or null).

    Rows that go have no near pair at that shingle and never will, as labels only grow together; linked sets of different labels stay at all
    shingles that they share. A group gives no more rows than it has.
    """

    def emit(table):
        if not len(table):
            return
        sig, _, pairs = pairs_of(table, least)
        none = np.iinfo(np.int64).max
        first, stays = np.full(len(sig), none), np.zeros(len(sig), bool)
        for i, j in pairs:
            stays[i] = stays[j] = True
            np.minimum.at(first, np.where(sig[i] > sig[j], i, j), np.minimum(sig[i], sig[j]))
        rows = table.select(["token", "place", "sig"]).filter(pa.array(stays)).combine_chunks()
        if len(rows):
            u = first[stays]
            yield from rows.append_column("u", pa.array(u, mask=u == none)).to_batches()

    return met(shared, labels, nodes, emit, "token bigint, place int, sig bigint, u bigint")


def stars(partners: DataFrame) -> DataFrame:
    """u, v: for each set v at most one of its first partners, that of most shingles.

    In a group of sets that are all alike most have the same one, so as many pairs as sets bring it together; `candidates` gives the pairs that are still apart.
    """
    times = partners.where("u is not null").groupBy("u", F.col("sig").alias("v")).agg(F.count("*").alias("times"))
    return times.groupBy("v").agg(F.max_by("u", F.struct("times", "u")).alias("u")).select("u", "v")


def candidates(shared: DataFrame, labels: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """u, v: pairs of nodes (sig, n, bits) with different labels that meet at enough shingles of their prefixes (shared: token, place, sig)."""

    def emit(table):
        if not len(table):
            return
        sig, n, found = pairs_of(table, least)
        for i, j in found:
            need = least_shared(n[i], n[j], least)
            pairs, times = np.unique(np.stack([np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j]), need], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, pairs.T), pa.array(times)], names=["u", "v", "need", "times"])

    every = met(shared, labels, nodes, emit, "u bigint, v bigint, need bigint, times bigint")
    return every.groupBy("u", "v", "need").agg(F.sum("times").alias("times")).where("times >= need").select("u", "v")


def verified(pairs: DataFrame, rows: DataFrame, holders: DataFrame, text: str, width: int, least: Fraction) -> DataFrame:
    """The pairs (u, v) whose whole sets have the similarity; holders has one row (__row) of each sig.

    The text of each v goes to its u, in one shuffle, and that of u once to every TOGETHER of its pairs, so that no u has all of them in one task.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = pairs.groupBy("u").agg(F.ceil(F.count("*") / TOGETHER).alias("salts"))
    salted = pinned(pairs.join(salts, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("salts")).alias("salt")))
    at = holders.select("sig", F.col("__row").alias("at"))
    sent = salted.join(at, F.col("v") == F.col("sig")).select("at", "u", "salt", "v")
    sent = sent.unionByName(salted.select("u", "salt").distinct().join(at, F.col("u") == F.col("sig")).select("at", "u", "salt", F.lit(None).cast("bigint").alias("v")))
    sent = pinned(sent)
    texts = rows.select("__row", rows[f"`{text}`"].alias("text")).join(if_small(sent, sent.count(), FEW), F.col("__row") == F.col("at"))
    dealt = texts.select("u", "salt", "v", "text").repartition(parts, "u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    p, q = least.numerator, least.denominator

    def run(batches):
        whole = None  # the set of the u whose pairs are read
        for batch in slices(batches):
            found = []
            for u, v, x in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "text"))):
                one = shingles(x, width)
                if v is None:
                    whole = one
                else:
                    both = len(np.intersect1d(whole, one, assume_unique=True))
                    if both * (p + q) >= (len(whole) + len(one)) * p:
                        found.append((u, v))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint")
