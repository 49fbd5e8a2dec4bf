"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a hash key. Words are summed by source and key bucket; the bucket in which a
source's budget ends is refined by the next bits of the key, and only its documents are read for
that. The result is one threshold a source: a filter picks the documents, nothing is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, n_words, pinned, set_apart

KEY_BITS = 60
#: Source tables of more rows than this are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


@dataclass
class Mix:
    """sized: id, source, size, key of each document. plan: source, source_size, target, rounds (whole
    copies of the source) and threshold (documents with a key up to it are taken once more)."""

    sized: DataFrame
    plan: DataFrame
    sources: int


def hash_key(ident: Column) -> Column:
    """60 bits of the id's MD5 as a long; a null id counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size -> the same with target: shares by weight, none above cap * source_size.

    Clamping and resharing until nothing is above its cap comes to min(cap * size, level * weight) with one
    level for all. With the sources in order of cap * size / weight, the clamped ones are a prefix.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)).withColumn("most", F.lit(cap) * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level)
    first_open = F.min(F.when(F.col("level") < F.col("most") / F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything)["level"]
    return levels.withColumn("target", F.least(F.col("most"), F.coalesce(first_open * F.col("weight"), F.col("most")))).select("source", "source_size", "target")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, bits: int = 12, ident: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """Plan the mix of a table of documents.

    Sources in code-point order (null last, a source of its own) have the given weights in turn and share
    `share` times all words; no source gives more than `cap` times its own. A null or empty text has no words and
    adds nothing; an empty table gives an empty plan. Repeated rows with one id share a key and are taken together.
    The words taken are as near to a source's target as whole documents in key order allow: the last one
    is in if at least half of it fits.
    """
    sized = pinned(docs.select(docs[ident].alias("ident"), docs[source].alias("source"), n_words(docs[text]).alias("size"), hash_key(docs[ident]).alias("key")))
    shift = KEY_BITS - bits
    histogram = pinned(sized.groupBy("source", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("words")))
    sizes = histogram.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, weights, share, cap)
    plan = plan.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = pinned(plan.withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")))
    count = plan.count()

    by_source = Window.partitionBy("source").orderBy("bucket")
    budget = plan.select(F.col("source").alias("plan_source"), "rest")
    spent, cells = None, histogram
    for level in range(2):
        joined = cells.join(if_small(budget, count, MAX_BROADCAST_SOURCES), same(F.col("source"), F.col("plan_source")))
        upto = joined.withColumn("upto", F.sum("words").over(by_source)) if spent is None else joined.withColumn("upto", F.sum("words").over(by_source) + F.col("spent"))
        edge = upto.where((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        spent = pinned(edge.select(F.col("source").alias("edge_source"), F.col("bucket").alias("edge"), (F.col("upto") - F.col("words")).alias("spent")))
        in_edge = sized.join(if_small(spent, count, MAX_BROADCAST_SOURCES), same(F.col("source"), F.col("edge_source")) & (F.shiftright("key", shift) == F.col("edge")))
        shift = shift - bits if level == 0 else 0
        cells = in_edge.groupBy("source", F.shiftright("key", shift).alias("bucket"), "spent").agg(F.sum("size").alias("words"))
    # The last cells are single keys of the refined bucket.
    last = cells.join(if_small(budget, count, MAX_BROADCAST_SOURCES), same(F.col("source"), F.col("plan_source")))
    last = last.withColumn("upto", F.sum("words").over(by_source) + F.col("spent")).where(F.col("upto") - F.col("words") / 2 <= F.col("rest"))
    ends = last.groupBy("source").agg(F.max("bucket").alias("last_key"))
    edges = spent.join(ends.withColumnRenamed("source", "end_source"), same(F.col("edge_source"), F.col("end_source")), "left")
    first_key = F.shiftleft("edge", KEY_BITS - 2 * bits)
    edges = edges.select("edge_source", F.coalesce("last_key", first_key - 1).alias("threshold"))
    everything = F.lit((1 << KEY_BITS) - 1)
    plan = plan.join(edges, same(F.col("source"), F.col("edge_source")), "left")
    # No edge: the rest covers the whole source, or there is no rest at all.
    plan = plan.withColumn("threshold", F.coalesce("threshold", F.when(F.col("rest") > 0, everything).otherwise(F.lit(-1))))
    return Mix(sized, pinned(plan.select("source", "source_size", "target", "rounds", "threshold")), count)


def taken(mixed: Mix) -> DataFrame:
    """A row a document: doc_id, source, size, source_size, target, copies and taken (words, repeats counted)."""
    plan = if_small(mixed.plan.withColumnRenamed("source", "plan_source"), mixed.sources, MAX_BROADCAST_SOURCES)
    rows = mixed.sized.join(plan, same(F.col("source"), F.col("plan_source")))
    copies = F.col("rounds") + (F.col("key") <= F.col("threshold")).cast("long")
    return rows.select(F.col("ident").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents with their own columns, each repeated as often as the mix takes it; the others go.

    A null source is one of its own, null ids share a key, documents without words come as often as their key says.
    """
    rows, (ident, text, source), back = set_apart(docs, ident, text, source)
    mixed = mix(rows, ident=ident, text=text, source=source, **options)
    plan = mixed.plan.select(F.col("source").alias("of"), "rounds", "threshold")
    joined = rows.join(if_small(plan, mixed.sources, MAX_BROADCAST_SOURCES), same(F.col(source), F.col("of")))
    copies = F.col("rounds") + (hash_key(F.col(ident)) <= F.col("threshold")).cast("long")
    return back(joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))))
