"""SimHash near-duplicates: fingerprints, links by vantage-point partitioning, and their components.

Two 64-bit fingerprints link when at most r bits differ. They then agree on 2 of r + 2 bit blocks at
least, and their distances to any vantage point differ by r at most (the triangle bound). So every fingerprint goes
to one shard for each pair of blocks: the shard of its bits there and of its band of distance to a
vantage point; and, as a guest, to the shard of the band below, whose boundary it may overlap. Inside a shard a vantage-point
tree prunes by the same bound. A shard gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import TO_LOWER, first_rows, if_small, numbered, pinned, release, set_apart
from .graph import components, roots

LEAF = 256
SMALL = 32
#: How often each document is compared with one likely partner before all pairs that are still apart are.
ROUNDS = 2


# Fingerprints


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of the shingles of `width` lower-cased words, as a signed 64-bit integer; 0 if there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return votes(np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64))


def votes(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer."""
    n = len(hashes)
    # Eight byte lanes are added at once; a lane holds up to 255 rows.
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").view(np.uint64)
    ones = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident and fp (bigint) of every document; a null text counts as empty."""
    rows = docs.select(docs[ident].alias("ident"), docs[text].alias("text"))
    kind = rows.schema["ident"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x, width) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("ident"), pa.array(fps, pa.int64())], names=["ident", "fp"])

    return rows.mapInArrow(run, f"ident {kind}, fp bigint")


# Links inside one shard


def tree_links(points: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of indices) that join the same components as all pairs within r bits do.

    A vantage-point tree walked while it is built. All points within r of the vantage point link to it. Those
    within r / 2 can then only add links to points at r + 1 to r + r / 2 (triangle bound), which are
    looked at, and drop out. The others part at the median distance into two overlapping shards.
    """
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def brute(x: np.ndarray, y: np.ndarray) -> None:
        """Compare x with y in blocks; each block gives a star for each of its components, not its pairs."""
        step = max(1, (1 << 20) // max(1, len(y)))
        for k in range(0, len(x), step):
            rows = x[k : k + step]
            near = np.bitwise_count(points[rows, None] ^ points[None, y]) <= r
            low_x, low_y = rows.copy(), y.copy()
            while near.any():
                new_x = np.minimum(low_x, np.where(near, low_y[None, :], len(points)).min(axis=1))
                new_y = np.minimum(low_y, np.where(near, new_x[:, None], len(points)).min(axis=0))
                if np.array_equal(new_x, low_x) and np.array_equal(new_y, low_y):
                    break
                low_x, low_y = new_x, new_y
            for at, low in ((rows, low_x), (y, low_y)):
                found_a.append(at[at != low])
                found_b.append(low[at != low])

    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        if len(at) <= LEAF:
            brute(at, at)
            continue
        v = at[0]
        d = np.bitwise_count(points[at] ^ points[v]).astype(np.int64)
        near = at[d <= r]
        found_a.append(np.full(len(near), v))
        found_b.append(near)
        close = d <= r // 2
        brute(at[close], at[(d > r) & (d <= r + r // 2)])
        at, d = at[~close], d[~close]
        if not len(at):
            continue
        middle = int(np.median(d))
        inner, outer = at[d <= middle + r], at[d > middle]
        if len(inner) ** 2 + len(outer) ** 2 > 0.9 * len(at) ** 2:
            brute(at, at)  # the bound hardly prunes here
        else:
            stack += [inner, outer]
    return np.concatenate(found_a), np.concatenate(found_b)


def shard_links(shard: np.ndarray, fp: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by shard: (fingerprint, smallest-index fingerprint linked to it in its shard)."""
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(shard)]]))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        x, y = tree_links(fp[s : s + n], r)
        a.append(x + s)
        b.append(y + s)
    few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for step in range(1, SMALL):
        i = few[:-step]
        j = few[step:]
        same = (shard[i] == shard[j]) if len(i) else np.zeros(0, bool)
        if not same.any():
            break
        i, j = i[same], j[same]
        linked = np.bitwise_count(fp[i] ^ fp[j]) <= r
        a.append(i[linked])
        b.append(j[linked])
    a, b = np.concatenate(a), np.concatenate(b)
    used, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = used[roots(len(used), index[: len(a)], index[len(a) :])] if len(used) else used
    return fp[used[root != used]], fp[root[root != used]]


# Links over Spark


def blocks(r: int) -> list[int]:
    """r + 2 masks that part the 64 bits into nearly equal blocks."""
    edges = [round(64 * k / (r + 2)) for k in range(r + 3)]
    return [sum(1 << i for i in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(fp: Column, r: int) -> Column:
    """The shards of a fingerprint, home and guest, as an array of bigint."""
    out = []
    for k, (x, y) in enumerate(combinations(blocks(r), 2)):
        vantage = signed(xxhash.xxh64_intdigest(f"vantage {k}"))
        band = F.floor(F.bit_count(fp.bitwiseXOR(F.lit(vantage))) / (r + 1)).cast("int")
        bits = fp.bitwiseAND(F.lit(signed(x | y)))
        out += [F.xxhash64(F.lit(k), bits, band), F.xxhash64(F.lit(k), bits, band - 1)]
    return F.array(*out)


def links(fps: DataFrame, r: int = 4) -> DataFrame:
    """u, v (bigint): links between distinct fingerprints (column fp) that join all that differ in r bits or fewer."""
    n = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = fps.select(F.explode(shards(F.col("fp"), r)).alias("shard"), "fp").repartition(int(n), "shard").sortWithinPartitions("shard")

    def run(batches):
        shard, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            shard = np.concatenate([shard, batch.column("shard").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            # The last shard may go on in the next batch.
            cut = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0
            if cut:
                yield from emit(shard[:cut], fp[:cut])
                shard, fp = shard[cut:], fp[cut:]
        if len(shard):
            yield from emit(shard, fp)

    def emit(shard, fp):
        u, v = shard_links(shard, fp, r)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def clustered(docs: DataFrame, width: int = 4, r: int = 4, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, fp and component_id (the smallest ident that links reach) of every document.

    Texts without words have the fingerprint zero and link like any other. Equal fingerprints are one node,
    so copies cost no links. Null idents are never the smallest unless a component has no other; repeated rows
    come out as often as they came in; an empty table gives an empty table.
    """
    prints = pinned(fingerprints(docs, width, ident, text))
    nodes = pinned(prints.groupBy("fp").agg(F.min("ident").alias("first")))
    found = components(links(nodes.select("fp"), r))
    labelled = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = pinned(labelled.join(firsts, "label").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("ident", "fp", "component_id")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Links (u, v) of the components that labels (node, label) has, and more of them."""
    return labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more)


def first_documents(docs: DataFrame, width: int = 5, least: float = 0.8, r: int = 4, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id (nulls last), with its own columns.

    Two documents are linked if their sets of shingles have a Jaccard similarity of at least `least`; a group is what links join.
    Fingerprints within r bits give most links cheaply, and each is held against the whole sets. A fingerprint of 64
    bits cannot promise a similarity, so the pairs that these groups leave apart are then sought by shared rare shingles, which misses none;
    before that, each set is held against one of those, so that large groups are one by then.
    Texts without words are one group; rows are told apart by a row id of their own, so different texts without an id, or
    under one id, all stay; an empty table gives an empty table.
    """
    rows, (ident, text), back = set_apart(docs, ident, text)
    rows = numbered(rows)
    share = Fraction(least).limit_denominator(1000)
    every = pinned(jaccard.sets(rows, text, width, share, votes))
    nodes = pinned(every.groupBy("sig").agg(F.min(F.struct("__row", "fp")).alias("x")).select("sig", "x.*"))
    heads = pinned(nodes.groupBy("fp").agg(F.min("sig").alias("head")))
    found = links(heads.select("fp"), r)
    near = found.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = nodes.join(heads, "fp").where("sig <> head").select(F.col("sig").alias("u"), F.col("head").alias("v"))
    near = pinned(jaccard.verified(pinned(near.unionByName(same)), rows, nodes, text, width, share))
    release(rows.sparkSession)
    del found, same, heads
    shared = jaccard.shared_tokens(every, nodes)
    every = pinned(every.select("__row", "sig", "n", "bits"))
    release(rows.sparkSession)
    facts = every.dropDuplicates(["sig"]).select("sig", "n", "bits")
    labels = pinned(components(near))
    for _ in range(ROUNDS):
        shared = pinned(jaccard.first_partners(shared, labels, facts, share))
        release(rows.sparkSession)
        more = jaccard.verified(pinned(jaccard.stars(shared)), rows, nodes, text, width, share)
        labels = pinned(components(joined(labels, more)))
        release(rows.sparkSession)
    pairs = pinned(jaccard.candidates(shared, labels, facts, share))
    del shared
    release(rows.sparkSession)
    labels = components(joined(labels, jaccard.verified(pairs, rows, nodes, text, width, share)))
    release(rows.sparkSession)
    groups = every.join(labels, F.col("sig") == F.col("node"), "left").select("__row", F.coalesce("label", "sig").alias("group"))
    out = first_rows(rows, groups, ident)
    release(rows.sparkSession)
    return back(out)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
