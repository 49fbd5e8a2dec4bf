"""Chunk sampling and batching of records. Every draw is a hash of key and seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import uniform
from ..functions.prefix import placed, running_sums
from ..session import pinned
from .keyed import in_blocks


def sequential_chunks(rows: DataFrame, keep: list[str], frames: str, size: int, overlap: int = 0, tail: bool = True) -> DataFrame:
    """Windows of `size` frames, and one that ends at the end where they do not come out even (O25): first, last (inclusive)."""
    n, step = F.col(frames).cast("int"), size - overlap
    whole = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step))).otherwise(F.array().cast("array<int>"))
    if tail:
        whole = F.when((n >= size) & (F.element_at(whole, -1) < n - size), F.concat(whole, F.array(n - size))).otherwise(whole)
    return rows.select(*keep, F.posexplode(whole).alias("chunk", "first")).withColumn("last", F.col("first") + size - 1)


def random_chunks(rows: DataFrame, keep: list[str], key: str, frames: str, size: int, per_row: int, seed: int) -> DataFrame:
    """per_row windows of each row that is long enough, at hashed places."""
    out = rows.where(F.col(frames) >= size).select(*keep, F.col(key).alias("__k"), F.col(frames).alias("__n"), F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("chunk"))
    first = F.floor(uniform(F.concat_ws("/", "__k", "chunk"), seed) * (F.col("__n") - size + 1)).cast("int")
    return out.withColumn("first", first).withColumn("last", F.col("first") + size - 1).drop("__k", "__n")


def balanced_chunks(rows: DataFrame, group: str, key: str, frames: str, size: int, overlap: float, seed: int, limit: int | None = None) -> DataFrame:
    """Overlapping windows, then as many for each group: those of the largest, or `limit`.

    Groups with more are sampled by hash; groups with fewer repeat theirs at new hashed places.
    """
    base = sequential_chunks(rows, [group, key, frames], frames, size, int(size * overlap), tail=False)
    w = Window.partitionBy(group)
    ranked = base.withColumn("__n", F.count("*").over(w)).withColumn("__rank", F.row_number().over(w.orderBy(uniform(F.concat_ws("/", key, "chunk"), seed), key, "chunk")))
    most = ranked.agg(F.max("__n").alias("__most"))
    want = F.lit(limit) if limit else F.col("__most")
    ranked = ranked.join(F.broadcast(most)).withColumn("__want", want.cast("int"))  # one row
    copies = F.ceil((F.col("__want") - F.col("__rank") + 1) / F.col("__n")).cast("int")
    out = ranked.where(F.col("__rank") <= F.col("__want")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(copies - 1, F.lit(0)))))
    again = F.floor(uniform(F.concat_ws("/", key, "chunk", "copy"), seed + 1) * (F.col(frames) - size + 1)).cast("int")
    out = out.withColumn("first", F.when(F.col("copy") > 0, again).otherwise(F.col("first")))
    return out.select(group, key, "chunk", "copy", "first", (F.col("first") + size - 1).alias("last"))


def listed_chunks(rows: DataFrame, keep: list[str], chunks: str) -> DataFrame:
    """Windows of a string like 's_e#s_e' (O27)."""
    out = rows.select(*keep, F.posexplode(F.split(chunks, "#")).alias("chunk", "__c"))
    part = F.split("__c", "_")
    return out.withColumn("first", part[0].cast("long")).withColumn("last", part[1].cast("long")).drop("__c")


def crop(values: Column, key: Column, size: int, seed: int, where: str = "random") -> Column:
    """A window of an array at its start, its end or a hashed place; a short array is repeated to the length."""
    n = F.size(values)
    first = {"start": F.lit(1), "end": n - size + 1, "random": F.floor(uniform(key, seed) * (n - size + 1)).cast("int") + 1}[where]
    tiled = F.slice(F.flatten(F.array_repeat(values, F.ceil(F.lit(size) / F.greatest(n, F.lit(1))).cast("int"))), 1, size)
    return F.when(n >= size, F.slice(values, F.greatest(first, F.lit(1)), size)).otherwise(tiled)


def weighted_pick(rows: DataFrame, choices: DataFrame, key: str, seed: int, name: str = "name", p: str = "p") -> DataFrame:
    """rows with a choice drawn by probability (O22). choices is a short list and goes along as an array."""
    total = F.sum(p).over(Window.partitionBy())
    upto = choices.withColumn("__hi", F.sum(p).over(Window.orderBy(name)) / total)
    listed = upto.agg(F.array_sort(F.collect_list(F.struct("__hi", name))).alias("__choices"))
    drawn = uniform(F.col(key), seed)
    return rows.join(F.broadcast(listed)).withColumn("choice", F.filter("__choices", lambda c: c["__hi"] > drawn)[0][name]).drop("__choices")  # one row


def smoothed(p: Column, share: float, n: Column) -> Column:
    """Probabilities mixed with the uniform distribution."""
    return (1 - share) * p + share / n


def noise_assignment(rows: DataFrame, noises: list[tuple[str, float]], key: str, length: str, snrs: list[float], seed: int) -> DataFrame:
    """key, place, noise, start, snr: noises one after the other until a row's length is covered (O23). Draws are hashes of key and place."""
    names, lengths = [n for n, _ in noises], [d for _, d in noises]

    @F.pandas_udf("array<struct<noise: string, start: double, snr: double>>")
    def run(keys: pd.Series, totals: pd.Series) -> pd.Series:
        out = []
        for k, total in zip(keys, totals):
            draws = np.random.default_rng([seed, int.from_bytes(str(k).encode(), "little") % (1 << 63)])
            at, picks = 0.0, []
            while at < total:
                i = int(draws.integers(len(names)))
                picks.append({"noise": names[i], "start": at, "snr": float(snrs[int(draws.integers(len(snrs)))])})
                at += max(lengths[i], 1e-3)
            out.append(picks)
        return pd.Series(out)

    return rows.select(key, F.posexplode(run(key, F.col(length).cast("double"))).alias("place", "p")).select(key, "place", "p.*")


def bins(rows: DataFrame, key: str, length: str, n: int) -> DataFrame:
    """Rows dealt over n bins in a snake by falling length, so that the bins' lengths are near each other."""
    lap, at = F.floor(F.col("__place") / n), F.col("__place") % n
    ordered = placed(rows, [F.col(length).desc(), F.col(key)])
    return ordered.withColumn("bin", F.when(lap % 2 == 0, at).otherwise(n - 1 - at).cast("int")).drop("__place")


def group_parts(groups: DataFrame, group: str, size: str, n: int) -> DataFrame:
    """Contiguous parts of whole groups with nearly equal sums (O15): a group goes where its middle lies."""
    total = groups.agg(F.sum(size)).first()[0] or 1
    upto = running_sums(groups, [F.col(group)], {"__upto": F.col(size)})
    return upto.withColumn("part", F.least(F.floor((F.col("__upto") - F.col(size) / 2) * n / F.lit(total)), F.lit(n - 1)).cast("int")).drop("__upto")


def balanced_parts(groups: DataFrame, group: str, size: str, n: int, around: int | None = None) -> DataFrame:
    """Contiguous parts of whole groups (one row each), in whose boundaries no move of one group makes two neighbours more alike.

    Parts start with equal numbers of groups; then, from part to part until nothing changes, the group at an end goes over if that brings the sums of the two
    parts closer. The driver holds the n sums and the sizes of `around` groups to both sides of each boundary, which are fetched anew where a boundary
    leaves them. Fewer groups than parts are an error; sizes are whole numbers, a null one counts as 0.
    """
    rows = pinned(placed(groups.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0))), [F.col(group)]))
    count = rows.count()
    if count < n:
        raise ValueError(f"{count} groups do not make {n} parts")
    around = around or max(1, 100_000 // n)
    first = [-(-k * count // n) for k in range(n)] + [count]  # the place of the first group of each part
    part = F.floor(F.col("__place") * n / F.lit(count)).cast("int")
    sums = dict(rows.groupBy(part.alias("part")).agg(F.sum("__size").alias("sum")).collect())
    sums = [sums[k] for k in range(n)]
    sizes: dict[int, int] = {}

    def goes(k: int, place: int, of: int, to: int) -> bool:
        """Move the group at a place from one part to its neighbour, if that brings them closer."""
        own = sizes[place]
        better = abs((sums[to] + own) - (sums[of] - own)) < abs(sums[to] - sums[of])
        if better:
            sums[of], sums[to] = sums[of] - own, sums[to] + own
            first[k] += 1 if to < of else -1
        return better

    changed = True
    while changed:
        changed = False
        for k in range(n):
            for end in (True, False):
                to = k + 1 if end else k - 1
                if 0 <= to < n and first[k] < first[k + 1]:
                    place = first[k + 1] - 1 if end else first[k]
                    if place not in sizes:
                        sizes = near_places(rows, first[1:-1], around)
                    changed |= goes(k + end, place, k, to)
    starts = F.array(*[F.lit(x) for x in first[1:-1]]) if n > 1 else F.array().cast("array<int>")
    return rows.withColumn("part", F.size(F.filter(starts, lambda x: x <= F.col("__place")))).drop("__place", "__size")


def near_places(rows: DataFrame, bounds: list[int], around: int) -> dict[int, int]:
    """place -> size of the rows (__place, __size) up to `around` places from a bound."""
    spans = rows.sparkSession.createDataFrame([(b,) for b in sorted(set(bounds))], "b bigint")
    wanted = spans.select(F.explode(F.sequence(F.col("b") - around, F.col("b") + around - 1)).alias("__place")).distinct()
    return dict(rows.join(F.broadcast(wanted), "__place").select("__place", "__size").collect())  # at most 2 around rows a bound


def spread(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows spread evenly over the order (W9): the first of each of n nearly equal blocks."""
    return in_blocks(rows, n, [F.col(order)], "__p").groupBy("__p").agg(F.min(order).alias(order)).drop("__p")


def shards(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """rows with shard: blocks of `size` rows of the seeded shuffle."""
    return placed(rows, [uniform(F.col(key), seed), F.col(key)]).withColumn("shard", F.floor(F.col("__place") / size)).drop("__place")


def manifest(sharded: DataFrame, length: str) -> DataFrame:
    """shard, length, rows."""
    return sharded.groupBy("shard").agg(F.sum(length).alias("length"), F.count("*").alias("rows"))


def archive_plan(groups: DataFrame, group: str, archives: int, least: int, most: int, per_archive: int, seed: int) -> DataFrame:
    """archive, length, group, offset share: geometric chunk lengths by archive, groups in seeded order round-robin."""
    lengths = [int(round(least * (most / least) ** (i / max(1, archives - 1)))) for i in range(archives)]
    table = groups.sparkSession.createDataFrame(list(enumerate(lengths)), "archive int, length int")
    pairs = groups.select(group).distinct().crossJoin(F.broadcast(table))  # a row an archive
    draw = uniform(F.concat_ws("/", "archive", group), seed)
    rank = F.row_number().over(Window.partitionBy("archive").orderBy(draw, group))
    return pairs.withColumn("__r", rank).where(F.col("__r") <= per_archive).withColumn("at", uniform(F.concat_ws("/", group, "archive"), seed + 1)).drop("__r")
