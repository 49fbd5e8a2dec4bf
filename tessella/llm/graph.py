"""Components of links, inside a task and over Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned

#: A node with more links than this, and than an eighth of a partition's fair share, is joined by broadcast.
HUB = 64


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of the component of each of n nodes, for links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def to_least(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """rows (u, v) with m, the label of their u in least (u, m, c: rows of that u).

    Hubs have c above their share of all links, so there are at most 16 a partition, however many rows there are: they are
    broadcast, and their rows stay where they are. The others are shuffled by u.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hubs = F.broadcast(least.where(F.col("c") > max(HUB, links // (8 * parts))).select("u", "m"))
    # The same grouping feeds both sides, so Spark computes it once.
    at_hubs = rows.join(hubs, "u").select("u", "v", "m")
    return rows.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m"), "u").select("u", "v", "m").unionByName(at_hubs)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of the edges (u, v).

    Alternating large and small stars (Kiveris et al., 2014): each round is two groupings with partial
    aggregation and two joins, and components of any shape take O(log^2 n) rounds.
    """

    def oriented(rows: DataFrame) -> DataFrame:
        return rows.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = pinned(oriented(edges))
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = to_least(both, least, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = pinned(oriented(large))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = to_least(large, least, 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = pinned(oriented(small))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
