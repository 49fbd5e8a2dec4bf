"""The part of the language model that grows with the corpus: which passage follows which words, as Spark tables.

Texts are cut where a hash of two words says so, every MEAN_WORDS words on average, so that copies are cut alike wherever
they begin. A table keeps how often each passage followed each context (the CONTEXT words before it) in all training documents;
it has no bound but the corpus. A passage of a text then has the probability w a / n + (1 - w) p, with p from the decisions
of its words, a and n the counts of the passage and of its context, and the weight w = n / (n + t) gated by the context
itself, which had t different passages (Witten-Bell). A training document is left out of its own counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned

MEAN_WORDS = 32
CONTEXT = 4
FACTOR = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xD6E8FEB86659FD93)
#: A key with more than this share of all passages is joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 0.001

PASSAGES = "array<struct<context: bigint, passage: bigint, single: double>>"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(32))) * OTHER
    return x ^ (x >> np.uint64(29))


def back(words: np.ndarray, first_of: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the word k places before each place; 0 before its text begins."""
    return np.where(at - k >= first_of, words[np.maximum(at - k, 0)], np.uint64(0))


def cut(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where passages start in a stream of word hashes (`first` marks the first word of each text), with hashes of their contexts and words."""
    starts = first.copy()
    pair = np.zeros(len(words), np.uint64)
    pair[2:] = mixed(words[1:-1] * FACTOR + words[:-2])
    inside = ~first
    inside[1:] &= ~first[:-1]
    starts |= inside & (pair % np.uint64(MEAN_WORDS) == 0)
    starts = np.flatnonzero(starts)
    sizes = np.diff(starts, append=len(words))
    texts = np.flatnonzero(first)
    first_of = texts[np.searchsorted(texts, starts, "right") - 1]
    context = np.zeros(len(starts), np.uint64)
    for k in range(1, CONTEXT + 1):
        context = context * FACTOR + back(words, first_of, starts, k)
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)), OTHER))
    terms = words * powers[np.arange(len(words)) - np.repeat(starts, sizes)]
    passage = np.add.reduceat(terms, starts) if len(starts) else terms
    return starts, mixed(context), mixed(passage)


def joined(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join to right, whose weights sum to total at most; its few heavy rows, 1 / HOT_SHARE at most, are broadcast."""
    heavy = F.broadcast(pinned(right.where(F.col(weight) > total * HOT_SHARE)))
    light = right.where(F.col(weight) <= total * HOT_SHARE)
    return left.join(heavy, on).unionByName(left.join(heavy.select(*on), on, "left_anti").join(light, on))


def gains(scores: DataFrame) -> DataFrame:
    """row, gain: what the table adds to a text's log10 probability; from rows (row, held_out, passages). Texts without any are left out."""
    rows = scores.select("row", "held_out", F.inline("passages"))
    total = scores.agg(F.sum(F.size("passages"))).first()[0] or 0
    counts = pinned(rows.groupBy("context", "passage").agg(F.count("*").alias("rows"), F.count_if(~F.col("held_out")).alias("a")))
    # A context met once has nothing to say about its one passage.
    contexts = counts.groupBy("context").agg(F.sum("rows").alias("all"), F.sum("a").alias("n"), F.count_if(F.col("a") > 0).alias("t")).where("all > 1 and n > 0")
    known = pinned(joined(counts, pinned(contexts), ["context"], "all", total)).select("context", "passage", "rows", "a", "n", "t")
    own = (~F.col("held_out")).cast("int")
    a, n, t = F.col("a") - own, F.col("n") - own, F.col("t") - F.when((own == 1) & (F.col("a") == 1), 1).otherwise(0)
    met = joined(rows, known, ["context", "passage"], "rows", total).select("row", "single", a.alias("a"), n.alias("n"), t.alias("t")).where("n > 0")
    alone = F.log10(F.col("t") / (F.col("n") + F.col("t")))
    copied = F.log10(F.col("a") / (F.col("n") + F.col("t"))) - F.col("single")
    both = F.greatest(alone, copied) + F.log10(1 + F.pow(F.lit(10.0), F.least(alone, copied) - F.greatest(alone, copied)))
    return met.groupBy("row").agg(F.sum(F.when(F.col("a") > 0, both).otherwise(alone)).alias("gain"))
