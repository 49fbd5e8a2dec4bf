"""Keyed tables: filters, joins, unions, reshaping and splits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import uniform
from ..functions.prefix import placed, running_sums

#: Copies that augmentation makes of a key, by suffix.
AUGMENTED = ("-reverb", "-noise", "-music", "-babble")
#: Key sets of more rows than this are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; the count stops there."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


# Filters


def filter_keys(rows: DataFrame, ids: DataFrame, key: str, id_col: str | None = None, exclude: bool = False) -> DataFrame:
    """The rows whose key is (not) among the ids; rows that repeat stay as often as they are."""
    known = ids.select(F.col(id_col or key).alias("__id")).where("__id is not null").distinct()
    return rows.join(known, rows[key] == known["__id"], "left_anti" if exclude else "left_semi")


def with_augmented(ids: DataFrame, key: str, suffixes: tuple[str, ...] = AUGMENTED) -> DataFrame:
    """The ids and their augmented copies."""
    return ids.select(F.explode(F.array(*[F.concat(F.col(key).cast("string"), F.lit(s)) for s in ("", *suffixes)])).alias(key))


def filter_jobs(rows: DataFrame, jobs: DataFrame, key: str, job: str = "job") -> DataFrame:
    """Rows by job: jobs has (job, key), and a row comes once for each job that lists it (F2)."""
    return rows.join(jobs.select(job, key).distinct(), key)


def at_least(rows: DataFrame, length: Column, least: float, group: str, members: int, most: float | None = None) -> DataFrame:
    """Rows of enough (and not too much) length, then the groups that have enough of them left."""
    ok = rows.where((length >= least) & (length <= most if most is not None else F.lit(True)))
    return ok.withColumn("__n", F.count("*").over(Window.partitionBy(group))).where(F.col("__n") >= members).drop("__n")


def prefixed(key: Column, *parts: Column | str) -> Column:
    """A key with parts before it, joined by '-' (F15, S19)."""
    return F.concat_ws("-", *[F.lit(p) if isinstance(p, str) else p for p in parts], key.cast("string"))


def speed_to_suffix(key: Column) -> Column:
    """'sp0.9-x' becomes 'x-sp0.9' (F16)."""
    return F.regexp_replace(key, r"^(sp(?:0\.9|1\.1))-(.*)$", "$2-$1")


def speed_copies(rows: DataFrame, key: str, duration: str, factors: tuple[float, ...] = (0.9, 1.0, 1.1)) -> DataFrame:
    """A copy of each row for each factor, its duration divided by it and its key prefixed unless the factor is 1."""
    copies = rows.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    name = F.when(F.col("factor") == 1.0, F.col(key).cast("string")).otherwise(F.concat(F.lit("sp"), F.col("factor").cast("string"), F.lit("-"), F.col(key).cast("string")))
    return copies.withColumn(duration, F.col(duration) / F.col("factor")).withColumn(key, name)


def volume(rows: DataFrame, key: str, given: DataFrame, low: float, high: float, seed: int = 0) -> DataFrame:
    """rows with a volume: that of `given` (key, volume), or else a hashed uniform draw."""
    drawn = F.lit(low) + uniform(F.col(key), seed) * (high - low)
    return rows.join(given.select(key, F.col("volume").alias("__given")), key, "left").withColumn("volume", F.coalesce("__given", drawn)).drop("__given")


# Joins


def lookup(rows: DataFrame, values: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Left join to a table with unique keys; with strict, a row without a value is an error."""
    out = rows.join(small(values), key, "left")
    if strict:
        missing = [c for c in values.columns if c != key][0]
        out = out.where(F.when(F.col(missing).isNull(), F.raise_error(F.concat(F.lit("no value for "), F.col(key).cast("string")))).otherwise(True))
    return out


def weighted_scores(first: DataFrame, second: DataFrame, on: list[str], w1: float, w2: float, score: str = "score") -> DataFrame:
    """w1 * first + w2 * second for each row of the second; a missing first counts 0."""
    a = first.select(*on, F.col(score).alias("__first"))
    return second.join(a, on, "left").select(*on, (w2 * F.col(score) + w1 * F.coalesce("__first", F.lit(0.0))).alias(score))


def overlaps(a: DataFrame, b: DataFrame, group: str, width: float) -> DataFrame:
    """Pairs of intervals of one group that overlap: start, end, other_start, other_end, overlap.

    Both sides are dealt into time buckets of the given width, so the join has an equality; a pair is kept
    in the first bucket that both have.
    """

    def bucketed(df: DataFrame, s: str, e: str) -> DataFrame:
        first, last = F.floor(F.col(s) / width), F.ceil(F.col(e) / width) - 1
        return df.withColumn("__bucket", F.explode(F.sequence(first, F.greatest(first, last))))

    left = bucketed(a, "start", "end")
    others = {c: f"other_{c}" for c in b.columns if c != group}
    right = bucketed(b, "start", "end").withColumnsRenamed(others)
    joined = left.join(right, [group, "__bucket"]).where((F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end")))
    at = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("other_start") / width))
    return joined.where(F.col("__bucket") == at).drop("__bucket").withColumn("overlap", F.least("end", "other_end") - F.greatest("start", "other_start"))


def intersect_keys(tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Every table without the rows whose key some other table lacks."""
    keys = reduce(lambda a, b: a.join(b, key, "left_semi"), [t.select(key).distinct() for t in tables.values()])
    return {name: t.join(keys, key, "left_semi") for name, t in tables.items()}


# Union, split, reshape


def union_common(frames: list[DataFrame], lineage: str | None = None, key: str | None = None) -> DataFrame:
    """Union of the columns that all tables have (O6, O10); `lineage` is filled from the key where a table lacks it."""
    if lineage:
        frames = [f if lineage in f.columns else f.withColumn(lineage, F.col(key)) for f in frames]
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, [f.select(*common) for f in frames])


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def shuffled_rank(key: Column, seed: int, *by: str) -> Column:
    """Place (from 1) in a seeded shuffle of each group; the same for any partitioning."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(uniform(key, seed), key))


def split_even(rows: DataFrame, n: int, order: str) -> DataFrame:
    """Contiguous blocks 1 to n of rows in order, the first ones a row larger."""
    return in_blocks(rows, n, [F.col(order)], "part")


def in_blocks(rows: DataFrame, n: int, order: list[Column], name: str) -> DataFrame:
    """rows with their block, 1 to n, of nearly equal blocks in order, the first ones a row larger."""
    least, more = divmod(rows.count(), n)
    at, edge = F.col("__place"), more * (least + 1)
    block = F.when(at < edge, F.floor(at / (least + 1))).otherwise(more + F.floor((at - edge) / max(1, least))) + 1
    return placed(rows, order).withColumn(name, block.cast("int")).drop("__place")


def split_ceil(rows: DataFrame, n: int, order: str) -> DataFrame:
    """n contiguous blocks of ceil(rows / n) rows, the last one short."""
    size = max(1, -(-rows.count() // n))
    return placed(rows, [F.col(order)]).withColumn("part", (F.floor(F.col("__place") / size) + 1).cast("int")).drop("__place")


def pivot_scores(scores: DataFrame, row: str, col: str, names: list[str], score: str = "score") -> DataFrame:
    """A list of scores as a matrix, a missing one as -inf."""
    wide = scores.groupBy(row).pivot(col, names).agg(F.min(score))
    return wide.na.fill(float("-inf"), [str(n) for n in names])


def unpivot_scores(matrix: DataFrame, row: str, col: str, score: str = "score") -> DataFrame:
    """A matrix of scores as a list, without the missing ones."""
    names = [c for c in matrix.columns if c != row]
    return matrix.unpivot(row, names, col, score).where(F.col(score) > float("-inf"))


def per_group_sample(rows: DataFrame, key: str, group: str, n: int, seed: int) -> DataFrame:
    """n rows of each group by a seeded hash."""
    return rows.withColumn("__rank", shuffled_rank(F.col(key), seed, group)).where(F.col("__rank") <= n).drop("__rank")


def group_split(rows: DataFrame, group: str, percent: float, seed: int) -> DataFrame:
    """Whole groups for validation: column is_valid for int(percent of the groups) of them."""
    groups = placed(rows.select(group).distinct(), [uniform(F.col(group), seed), F.col(group)])
    chosen = groups.select(group, (F.col("__place") < math.floor(groups.count() * percent / 100)).alias("is_valid"))
    return rows.join(small(chosen), group)


def fraction_sample(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """int(rows * fraction) rows by a seeded hash."""
    n = int(rows.count() * fraction)
    return placed(rows, [uniform(F.col(key), seed), F.col(key)]).where(F.col("__place") < n).drop("__place")


def every_kth(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Up to n rows of each group, evenly spaced: every k-th with the largest k that still gives n."""
    w = Window.partitionBy(group)
    skip = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / n))
    ranked = rows.withColumn("__rank", F.row_number().over(w.orderBy(order))).withColumn("__skip", skip)
    return ranked.where(((F.col("__rank") - 1) % F.col("__skip") == 0) & (F.col("__rank") <= n * F.col("__skip"))).drop("__rank", "__skip")


def until_quota(groups: DataFrame, group: str, size: str, quota: float, seed: int) -> DataFrame:
    """Groups in seeded order until their sizes reach the quota."""
    upto = running_sums(groups, [uniform(F.col(group), seed), F.col(group)], {"__sum": F.col(size)})
    return upto.where(F.col("__sum") - F.col(size) < quota).drop("__sum")


def class_ids(rows: DataFrame, group: str) -> DataFrame:
    """Integer ids from 0 in the order of the groups."""
    ids = placed(rows.select(group).distinct(), [F.col(group)], "class_id").withColumn("class_id", F.col("class_id").cast("int"))
    return rows.join(small(ids), group)


def interleaved(rows: DataFrame, source: str, order: str, block: int) -> DataFrame:
    """Proportional interleaving of several lists into blocks: always from the least consumed."""
    ordered = placed(rows, [F.col(source), F.col(order)])
    sources = ordered.groupBy(source).agg(F.count("*").alias("__n"), F.min("__place").alias("__first")).withColumnRenamed(source, "__source")
    shares = ordered.join(small(sources), F.col(source).eqNullSafe(F.col("__source"))).withColumn("__share", (F.col("__place") - F.col("__first")) / F.col("__n"))
    out = placed(shares.select(*rows.columns, "__share"), [F.col("__share"), F.col(source)], "place")
    return out.withColumn("block", F.floor(F.col("place") / block)).drop("__share")
