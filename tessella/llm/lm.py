"""Language-model scoring by online logistic context mixing.

A token (a lower-cased word, or the end of a text) is coded as binary decisions down a tree over the
frequent words, whose leaves are in the order of the reversed spelling, so that words of one kind share
branches. The first LEVELS decisions are mixed; below them a word has a fixed share of its branch. Several bit
predictors look up hashed contexts (branches or words before this one) in tables of counts from all training documents; a
mixer adds their logits with weights that a gate picks by level and by how much the contexts have seen. A
document starts with the same weights by gate and refines them as it goes, segment by segment. Nothing is fitted on a
sample or in an order, so a score depends on the counts and on its own text only, not on the layout of the table. Words
outside the tree take its escape leaf and are spelled by interpolated letter 4-grams. The tree and its tables are of a
fixed size, whatever the corpus; what is gathered beyond them is in `passages`, whose tables grow with it and are joined to the texts.
So the score is a probability of the whole text, and gives its bits per byte.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import TO_LOWER, pinned

#: Words in the tree: those seen twice or more, at most so many.
MAX_WORDS = 250_000
LEVELS = 8
BRANCHES = 1 << LEVELS
#: log2 of the table sizes: branch before; two branches before; word before; three coarse branches before.
TABLE_BITS = (2 * LEVELS + 1, 20, 20, 20)
OFFSETS = np.concatenate([[0], np.cumsum([2 << b for b in TABLE_BITS])])
PIECE = 1 << 16
INPUTS = len(TABLE_BITS) + 2
GATES = LEVELS * 4 * 4
#: A gate is 16 times the level, plus the trust in two of the tables, by these factors.
GATED = {1: 4, 2: 1}
# The weights that every document starts with, by the trust (0 to 3) in the table that gates them.
ROOT_START = (0.35, 0.2, 0.0, 0.1)
BRANCH_START = (0.5, 0.5, 0.3, 0.35)
TWO_BRANCH_START = (0.3, 0.2, 0.45, 0.4)
WORD_START = (0.3, 0.3, 0.5, 0.45)
COARSE_START = (0.3, 0.25, 0.35, 0.4)
GATE_OF_NODE = np.array([16 * max(0, n.bit_length() - 1) for n in range(BRANCHES)])
SEGMENT = 32
RATE = 0.1
#: Words that are scored or counted at a time: their arrays fit into a core's cache.
CHUNK_WORDS = 25_000
#: Slots to gather before they are added up.
COUNT_EVENTS = 3_000_000
#: Tokens for a task that counts contexts, where there are so many.
TASK_TOKENS = 8_000_000
#: Counters for a worker to hold before it sends them on.
MAX_COUNTERS = 300_000
LN10 = math.log(10)

# Letter classes of bytes. 0 is the edge of a word.
LETTERS = 51
LETTER = np.full(256, 28, np.int64)
LETTER[ord("a") : ord("z") + 1] = np.arange(1, 27)
LETTER[ord("0") : ord("9") + 1] = 27
LETTER[[ord(c) for c in ".,|!"]] = 29, 30, 31, 32
LETTER[0xC0:] = 33
LETTER[0xC3] = 34
LETTER[0x80:0xC0] = 35 + (np.arange(64) >> 2)
#: How many bytes share a class.
SHARE = np.bincount(LETTER, minlength=LETTERS).astype(float)
SHARE[0] = 1


def tokens(text: str | bytes | None) -> list[bytes]:
    """The lower-cased words; the end is not among them."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").translate(TO_LOWER).split()


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 of each text of a batch, without a detour by str; null as empty."""
    for text in column:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def is_held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 7 == 2


# Counting words


def word_counts(training: DataFrame) -> DataFrame:
    """word, n over all training documents (column text); the end of a text is the word ''."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in utf8(batch.column("text")):
                counts.update(tokens(text))
                counts[b""] += 1
                if len(counts) > MAX_COUNTERS:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return training.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# Summing arrays of counts


def pieces_of(counts: np.ndarray, part: int) -> pa.RecordBatch:
    """An array as rows (piece, part, counts), without pieces of zeros."""
    found = [(k, counts[k * PIECE : (k + 1) * PIECE]) for k in range(-(-len(counts) // PIECE))]
    found = [(k, x) for k, x in found if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array([x.astype("<u4").tobytes() for _, x in found], pa.binary())], names=["piece", "part", "counts"])


PIECES = "piece int, part int, counts binary"


def summed(rows: DataFrame) -> DataFrame:
    """Add up the pieces of all parts in 64 bits, first within each part, then over the parts."""

    def run(kind):
        def add(batches):
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for piece, part, data in zip(*(batch.column(c).to_pylist() for c in ("piece", "part", "counts"))):
                    x = np.frombuffer(data, kind)
                    if (piece, part) in sums:
                        sums[piece, part] += x
                    else:
                        sums[piece, part] = x.astype(np.uint64)
            for (piece, part), x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part], pa.int32()), pa.array([x.astype("<u8").tobytes()], pa.binary())], names=["piece", "part", "counts"])

        return add

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows.repartition(n, "piece", "part").mapInArrow(run("<u4"), PIECES).withColumn("part", F.lit(0))
    return once.repartition(n, "piece").mapInArrow(run("<u8"), PIECES)


def gathered(rows: DataFrame, size: int) -> np.ndarray:
    """The summed array on the driver, as floats; its size is that of the model, whatever the corpus."""
    out = np.zeros(-(-size // PIECE) * PIECE, np.float32)
    for r in summed(rows).toLocalIterator():
        x = np.frombuffer(r["counts"], "<u8")
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(x)] = x
    return out[:size]


# Spelling


def spelled_counts(words: DataFrame) -> DataFrame:
    """gram, n: letter 4-grams over the distinct words."""

    def run(batches):
        for batch in batches:
            words = [w.encode() for w in batch.column("word").to_pylist() if w]
            if words:
                grams, n = np.unique(letter_grams(words)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    return words.select("word").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def letter_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of each 4-gram (three letters before and the letter, edges as 0), the word it is of, and the letter."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    text = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    ends = np.cumsum(sizes) - 1
    letters = LETTER[text]
    letters[ends] = 0
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(text)) - np.repeat(ends + 1 - sizes, sizes)
    index = letters.copy()
    for back in (1, 2, 3):
        before = np.concatenate([np.zeros(back, np.int64), letters[:-back]])[: len(letters)]
        index += np.where(place >= back, before, 0) * LETTERS**back
    return index, owner, letters


def spelling(counts: np.ndarray) -> np.ndarray:
    """log10 P(byte | three letters before), by 4-gram index, interpolated down to single letters."""
    n = counts.reshape((LETTERS,) * 4).astype(np.float32)
    p = np.full(LETTERS, 1 / LETTERS, np.float32)
    for order in range(4):
        own = n.sum(axis=tuple(range(3 - order)), dtype=np.float64).astype(np.float32) if order < 3 else n
        p = (own + 3 * p) / (own.sum(axis=-1, keepdims=True) + 3)
    np.log10(p, out=p)
    p -= np.log10(SHARE).astype(np.float32)
    return p.ravel()


# The tree and its contexts


@dataclass
class Tree:
    """ids: word -> leaf; the last leaf is the escape. A leaf has depth decisions from its place in steps on: 2 node + bit of each.
    fixed: log10 of a leaf's share of its branch. branch: where a leaf's decisions end. known: log10(n + 1) by leaf."""

    ids: dict[bytes, int]
    depth: np.ndarray
    place: np.ndarray
    steps: np.ndarray
    fixed: np.ndarray
    branch: np.ndarray
    coarse: np.ndarray
    known: np.ndarray
    root: np.ndarray

    @property
    def escape(self) -> int:
        return len(self.known)


def grow(words: list[bytes], n: np.ndarray, escaped: int) -> Tree:
    """words with their counts, the end of a text being b''."""
    order = sorted(range(len(words)), key=lambda i: words[i][::-1])
    words, n = [words[i] for i in order], n[order]
    mass = np.concatenate([n, [max(1, escaped)]]).astype(float)
    upto = np.concatenate([[0], np.cumsum(mass)])
    size = len(mass)
    nodes, bits = np.zeros((size, LEVELS), np.int16), np.zeros((size, LEVELS), np.uint8)
    branch, coarse = np.ones(size, np.int64), np.ones(size, np.int64)
    root = np.zeros(BRANCHES)
    spans = [(1, 0, size)]
    for level in range(LEVELS):
        below = []
        for node, lo, hi in spans:
            if hi - lo < 2:
                continue
            cut = int(np.searchsorted(upto, (upto[lo] + upto[hi]) / 2))
            cut = min(max(cut if upto[cut] + upto[cut - 1] <= upto[lo] + upto[hi] else cut - 1, lo + 1), hi - 1)
            nodes[lo:hi, level] = node
            bits[cut:hi, level] = 1
            root[node] = math.log((upto[hi] - upto[cut]) / (upto[cut] - upto[lo]))
            below += [(2 * node, lo, cut), (2 * node + 1, cut, hi)]
        for node, lo, hi in below:
            branch[lo:hi] = node
            if level == 3:
                coarse[lo:hi] = node
            elif level < 3:
                coarse[lo:hi] = node
        spans = below
    fixed = np.zeros(size)
    for b in np.unique(branch):
        at = branch == b
        fixed[at] = np.log10(mass[at] / mass[at].sum())
    depth = np.count_nonzero(nodes, axis=1)  # decisions come first, then zeros
    steps = (2 * nodes + bits)[nodes > 0].astype(np.int16)
    return Tree({w: i for i, w in enumerate(words)}, depth, np.cumsum(depth) - depth, steps, fixed.astype(np.float32), branch % BRANCHES, coarse % 16, np.log10(n + 1.0), root.astype(np.float32))


@dataclass
class Events:
    """Mixed decisions: how many each token has, and of each decision its bit, node and the slots of each table."""

    depth: np.ndarray
    bit: np.ndarray
    node: np.ndarray
    slots: list[np.ndarray]


def before(x: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """x of the token before; `start` at the first token of a text."""
    out = np.concatenate([[start], x[:-1]])
    out[first] = start
    return out


def events(tree: Tree, leaf: np.ndarray, first: np.ndarray, order: np.ndarray | None = None) -> Events:
    """The decisions of a stream of leaves; `first` marks the first token of each text, `order` the order to list them in."""
    branch, coarse = tree.branch[leaf], tree.coarse[leaf]
    b1, c1, w1 = before(branch, first, BRANCHES), before(coarse, first, 0), before(leaf + 1, first, 0)
    b2, c2 = before(b1, first, BRANCHES), before(c1, first, 0)
    c3 = before(c2, first, 0)
    mix = lambda x: (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    contexts = [b1, mix(b1 * (BRANCHES + 1) + b2), mix(w1), (c1 * 16 + c2) * 16 + c3]
    if order is not None:
        leaf, contexts = leaf[order], [c[order] for c in contexts]
    depth = tree.depth[leaf]
    each = lambda x: np.repeat(x, depth)
    steps = tree.steps[each(tree.place[leaf] - np.cumsum(depth) + depth) + np.arange(depth.sum())].astype(np.int64)
    node, bit = steps >> 1, steps & 1
    slots = []
    for k, (context, bits) in enumerate(zip(contexts, TABLE_BITS)):
        if k in (0, 3):
            slots.append(each(context * BRANCHES) + node)
        else:
            h = (each(context) + node.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            slots.append((h >> np.uint64(64 - bits)).view(np.int64))
    return Events(depth, bit, node, slots)


def leaves(tree: Tree, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Leaves of the tokens of some texts with their ends (b''); which tokens are first; the sizes; and the tokens."""
    get, escape = tree.ids.get, tree.escape
    flat: list[bytes] = []
    for words in docs:
        flat += words
        flat.append(b"")
    leaf = np.fromiter(map(get, flat, repeat(escape)), np.int64, len(flat))
    sizes = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
    first = np.zeros(len(flat), bool)
    first[np.cumsum(sizes) - sizes] = True
    return leaf, first, sizes, flat


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows with their tokens, about CHUNK_WORDS at a time; texts of like sizes come together."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(pc.fill_null(pc.binary_length(batch.column("text")), 0)))
        docs, start, count = [], 0, 0
        for i, text in enumerate(utf8(batch.column("text"))):
            docs.append(tokens(text))
            count += len(docs[-1])
            if count >= CHUNK_WORDS or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), docs
                docs, start, count = [], i + 1, 0


def context_counts(training: DataFrame, tree, parts: int = 64) -> DataFrame:
    """Counts of bits in every slot of the tables, as pieces; counter 2 s + bit of a table is for its slot s."""

    def run(batches):
        from pyspark import TaskContext

        counts = np.zeros(OFFSETS[-1], np.uint32)
        waiting: list[list[np.ndarray]] = [[] for _ in TABLE_BITS]

        def add():
            for k, slots in enumerate(waiting):
                if slots:
                    found = np.bincount(np.concatenate(slots))
                    counts[OFFSETS[k] : OFFSETS[k] + len(found)] += found.astype(np.uint32)
                slots.clear()

        held = 0
        for _, docs in chunks(batches):
            leaf, first, _, _ = leaves(tree.value, docs)
            e = events(tree.value, leaf, first)
            for slots, slot in zip(waiting, e.slots):
                slot *= 2
                slot += e.bit
                slots.append(slot.astype(np.int32))
            held += len(e.bit)
            if held >= COUNT_EVENTS:
                add()
                held = 0
        add()
        if counts.any():
            yield pieces_of(counts, TaskContext.get().partitionId() % parts)

    return training.select("text").mapInArrow(run, PIECES)


# Mixing


class Mixer:
    """Logits and gates from the tables, and the weights that each gate starts with."""

    def __init__(self, tree: Tree, counts: np.ndarray, spelled: np.ndarray):
        self.tree, self.spelled = tree, spelled
        self.names = passages.mixed(np.arange(1, tree.escape + 2, dtype=np.uint64) * passages.FACTOR)
        pairs = counts.reshape(-1, 2)
        self.logit, self.trust = np.empty(len(pairs), np.float32), np.empty(len(pairs), np.uint8)
        for k in range(0, len(pairs), PIECE):
            n = pairs[k : k + PIECE]
            self.logit[k : k + PIECE] = np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4))
            self.trust[k : k + PIECE] = np.digitize(n.sum(axis=1), (1, 16, 256))
        self.weights = np.zeros((LEVELS, 4, 4, INPUTS), np.float32)
        for k, start in enumerate((ROOT_START, BRANCH_START, TWO_BRANCH_START)):
            self.weights[..., k] = np.array(start)[:, None]
        for k, start in enumerate((WORD_START, COARSE_START)):
            self.weights[..., k + 3] = start
        self.weights = self.weights.reshape(GATES, INPUTS)

    def inputs(self, e: Events) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the mixer (a row each) and gates."""
        x = np.empty((INPUTS, len(e.node)), np.float32)
        x[0] = self.tree.root[e.node]
        x[-1] = 0.3
        gate = GATE_OF_NODE[e.node]
        for k, slot in enumerate(e.slots):
            at = slot + OFFSETS[k] // 2
            x[k + 1] = self.logit[at]
            if k in GATED:
                gate += GATED[k] * self.trust[at]
        return x, gate

    def score(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]], pa.ListArray]:
        """log10 probabilities of some texts; of each token its leaf and text number; the words of each text that are not in the tree; and its passages.

        All texts go through their segments side by side. The weights that a text adds to those of the
        gates follow the errors of its earlier segments only, so its score depends on nothing but itself and the model.
        """
        tree = self.tree
        leaf, first, sizes, flat = leaves(tree, docs)
        doc = np.repeat(np.arange(len(docs)), sizes)
        segment = (np.arange(len(leaf)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // SEGMENT
        order = np.argsort(segment.astype(np.uint16) if segment.max(initial=0) < 1 << 16 else segment, kind="stable")
        e = events(tree, leaf, first, order)
        x, gate = self.inputs(e)
        each = tree.fixed[leaf].astype(float)
        # From here on an event's inputs have the sign of its bit, so that its probability is 1 / (1 + exp(-z)).
        x *= (2 * e.bit - 1).astype(np.float32)
        fixed = np.zeros(len(gate), np.float32)
        for weights, xs in zip(self.weights.T, x):
            fixed += weights[gate] * xs
        # Runs of events of one text in one segment, and where the runs of each segment begin.
        owner, step = doc[order], segment[order]
        at = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(step, prepend=-1))
        sizes = np.add.reduceat(e.depth, at) if len(at) else at
        at, sizes = at[sizes > 0], sizes[sizes > 0]
        who, which, starts = owner[at], step[at], np.concatenate([[0], np.cumsum(sizes)])
        edges = np.flatnonzero(np.diff(which, prepend=-1, append=-1))
        delta, squares = np.zeros((len(docs), INPUTS), np.float32), np.ones((len(docs), INPUTS), np.float32)
        odds = np.empty(len(gate), np.float32)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            a, b, own = starts[i], starts[j], who[i:j]
            xs = x[:, a:b]
            z = fixed[a:b] + np.einsum("ij,ij->j", np.repeat(delta[own].T, sizes[i:j], axis=1), xs)
            odds[a:b] = o = np.exp(np.minimum(-z, 60))
            g = np.add.reduceat(o / (1 + o) * xs, starts[i:j] - a, axis=1).T / SEGMENT
            squares[own] += g * g
            delta[own] += RATE * g / np.sqrt(squares[own])
        if len(who):  # then each token has a decision
            each[order] -= np.add.reduceat(np.log(1 + odds), np.cumsum(e.depth) - e.depth) / LN10
        names = self.names[leaf]
        at = [i for i in np.flatnonzero(leaf == tree.escape).tolist() if flat[i]]
        rare: list[list[bytes]] = [[] for _ in docs]
        for i, d in zip(at, doc[at].tolist()):
            rare[d].append(flat[i])
        if at:
            index, which, _ = letter_grams([flat[i] for i in at])
            each[at] += np.bincount(which, self.spelled[index], len(at))
            names[at] = np.array([xxhash.xxh64_intdigest(flat[i]) for i in at], np.uint64)
        cuts, context, passage = passages.cut(names, first)
        single = np.add.reduceat(each, cuts) if len(cuts) else each
        found = pa.StructArray.from_arrays([pa.array(context.view(np.int64)), pa.array(passage.view(np.int64)), pa.array(single)], names=["context", "passage", "single"])
        ends = np.searchsorted(cuts, [*np.flatnonzero(first), len(leaf)])
        return np.bincount(doc, each, len(docs)), leaf, doc, rare, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


# Over Spark


def scored(docs: DataFrame, ident: str = "doc_id", text: str = "text", held_out: Column | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """ident, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document.

    Trained on the documents that are not held_out (by default crc32(ident) mod 7 = 2). Null texts are empty: their one token
    is the end. Without training documents all tokens are unknown. Null idents are trained on; repeated rows
    are scored each, and know each other's passages. A training document's own words are in the counts of decisions, but not in those of passages. bits_per_byte is null for empty texts. Words within max_words go with the model to all executors; the
    counts of the others are joined.
    """
    spark = docs.sparkSession
    out = is_held_out(docs[ident]) if held_out is None else held_out
    rows = docs.select(docs[ident].alias("ident"), docs[text].alias("text"), out.alias("held_out"))
    training = rows.where("not held_out")
    counts = pinned(word_counts(training))

    steps = sorted({max(2, round(1.5**k)) for k in range(2, 70)})
    sums = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), *[F.count(F.when(F.col("n") >= t, 1)).alias(f"t{t}") for t in steps]).first()
    tokens_seen, types = sums["tokens"] or 0, sums["types"]
    least = next((t for t in steps if sums[f"t{t}"] <= max_words), steps[-1])
    frequent = counts.where((F.col("n") >= least) | (F.col("word") == "")).toArrow()  # within max_words and the end
    words, n = [w.encode() for w in frequent.column("word").to_pylist()], frequent.column("n").to_numpy()
    tree = grow(words, n, tokens_seen - int(n.sum()))
    shared_tree = spark.sparkContext.broadcast(tree)
    grams = spelled_counts(counts).toArrow()  # a row for each 4-gram of letter classes at most
    spelled = np.zeros(LETTERS**4, np.int64)
    spelled[grams.column("gram").to_numpy()] = grams.column("n").to_numpy()
    spelled = spelling(spelled)
    # The counts of a task are of one size, so a task has a fair part of the corpus.
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-tokens_seen // TASK_TOKENS))
    slots = gathered(context_counts(training.coalesce(tasks), shared_tree, max(64, math.isqrt(tasks))), int(OFFSETS[-1]))
    mixer = Mixer(tree, slots, spelled)
    del slots
    model = spark.sparkContext.broadcast(mixer)
    kind = rows.schema["ident"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch, docs in chunks(batches):
            m = model.value
            score, leaf, doc, rare_words, found = m.score(docs)
            sizes = np.bincount(doc, minlength=len(docs))
            inside = leaf < m.tree.escape
            base = np.bincount(doc[inside], m.tree.known[leaf[inside]], len(docs))
            known = np.bincount(doc[inside], minlength=len(docs))
            times = [Counter(x) for x in rare_words]
            words = pa.array([w for c in times for w in c], pa.string())
            words_times = pa.StructArray.from_arrays([words, pa.array([n for c in times for n in c.values()], pa.int64())], names=["word", "times"])
            rare = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, times)]), pa.int32()), words_times)
            text_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            columns = [pa.array(np.arange(row, row + len(docs))), batch.column("ident"), batch.column("held_out"), pa.array(sizes), pa.array(known, pa.int64()), pa.array(base), pa.array(score), text_bytes, rare, found]
            row += len(docs)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "ident", "held_out", "n_tokens", "known", "base", "score", "bytes", "rare", "passages"])

    scores = pinned(rows.mapInArrow(run, f"row bigint, ident {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double, bytes bigint, rare array<struct<word: string, times: bigint>>, passages {passages.PASSAGES}"))
    rest = scores.select("row", F.inline("rare")).join(counts, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"))
    joined = scores.drop("rare", "passages").join(rest, "row", "left").join(passages.gains(scores), "row", "left")
    score = F.col("score") + F.coalesce("gain", F.lit(0.0))
    each = math.log10(tokens_seen + types + 1)
    return joined.select(
        "ident", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens_seen).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        score.alias("score"),
        F.when(F.col("bytes") > 0, -score * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )
