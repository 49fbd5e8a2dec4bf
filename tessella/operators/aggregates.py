"""Grouped statistics: lists, vectors, histograms, quotas."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays


def to_lists(rows: DataFrame, group: str, member: str, out: str = "members") -> DataFrame:
    """group -> sorted list of its members (A1)."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias(out))


def from_lists(lists: DataFrame, group: str, member: str, members: str = "members") -> DataFrame:
    """The inverse of to_lists (A2)."""
    return lists.select(F.explode(members).alias(member), group)


def timed_lists(rows: DataFrame, group: str, start: str, end: str, member: str) -> DataFrame:
    """group -> its members in order of time (A3)."""
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(start, end, member))), lambda x: x[member]).alias("members"))


def attributes(rows: DataFrame, group: str, frames: Column, per_hour: float = 360_000.0) -> DataFrame:
    """Counts of rows and groups, all frames and hours (A4)."""
    return rows.agg(F.count("*").alias("n_utts"), F.countDistinct(group).alias("n_spks"), F.sum(frames).alias("frames"), (F.sum(frames) / per_hour).alias("hours"))


def extremes(rows: DataFrame, key: str, length: Column) -> DataFrame:
    """Sum, mean, least and greatest length with their keys, the smaller key on ties (A5)."""
    return rows.agg(F.sum(length).alias("total"), F.avg(length).alias("mean"), F.min(length).alias("least"), F.min(F.struct(length.alias("l"), F.col(key).alias("k")))["k"].alias("least_key"), F.max(length).alias("most"), F.min(F.struct((-length).alias("l"), F.col(key).alias("k")))["k"].alias("most_key"))


def moments(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation by group (A7); the deviation of one row is null."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))


def mean_vectors(rows: DataFrame, by: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean of the vectors of a group, and how many there are.

    A row a dimension, so partial sums are made before the shuffle and a large group is never in one task.
    """
    w = F.lit(1.0) if weight is None else weight
    parts = rows.select(*by, w.alias("__w"), F.posexplode(arrays.doubles(F.col(vector))).alias("__pos", "__x"))
    dims = parts.groupBy(*by, "__pos").agg((F.sum(F.col("__x") * F.col("__w")) / F.sum("__w")).alias("__mean"), F.count("*").alias("__n"))
    collected = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__mean"))), lambda x: x["__mean"])
    return dims.groupBy(*by).agg(collected.alias("mean"), F.max("__n").alias("n"))


def pooled(rows: DataFrame, by: list[str], vector: str, weight: Column | None = None, floor: float = 1e-10) -> DataFrame:
    """Statistics pooling: means followed by deviations, with weights if given."""
    w = F.lit(1.0) if weight is None else weight
    parts = rows.select(*by, w.alias("__w"), F.posexplode(arrays.doubles(F.col(vector))).alias("__pos", "__x"))
    mean = F.sum(F.col("__x") * F.col("__w")) / F.sum("__w")
    square = F.sum(F.col("__x") * F.col("__x") * F.col("__w")) / F.sum("__w")
    dims = parts.groupBy(*by, "__pos").agg(mean.alias("__m"), F.sqrt(F.greatest(square - mean * mean, F.lit(floor))).alias("__s"))
    ordered = F.array_sort(F.collect_list(F.struct("__pos", "__m", "__s")))
    return dims.groupBy(*by).agg(F.concat(F.transform(ordered, lambda x: x["__m"]), F.transform(ordered, lambda x: x["__s"])).alias("stats"))


def scatter(rows: DataFrame, vector: str, group: str | None = None) -> tuple[np.ndarray, np.ndarray, int, pd.DataFrame | None]:
    """Sum of x x', sum of x, count, and the sums by group (A14, A15): partial sums in tasks, one small matrix each to add up.

    Sizes on the driver are those of the vectors' dimension, and of the number of groups where they are asked for.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        second = first = None
        n = 0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            second = x.T @ x if second is None else second + x.T @ x
            first = x.sum(0) if first is None else first + x.sum(0)
            n += len(x)
        if n:
            yield pd.DataFrame({"second": [second.ravel()], "first": [first], "n": [n]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for second, first, n in pdf.itertuples(index=False):
                total = (second, first, n) if total is None else (total[0] + second, total[1] + first, total[2] + n)
        if total is not None:
            yield pd.DataFrame({"second": [total[0]], "first": [total[1]], "n": [total[2]]})

    kind = "second array<double>, first array<double>, n bigint"
    parts = rows.select(arrays.doubles(F.col(vector)).alias("v")).mapInPandas(partial, kind)
    sums = parts.repartition(8).mapInPandas(added, kind).collect()  # eight matrices, however many partitions there are
    second, first, n = sum(np.array(r["second"]) for r in sums), sum(np.array(r["first"]) for r in sums), sum(r["n"] for r in sums)
    second = second.reshape(len(first), -1)
    groups = mean_vectors(rows, [group], vector).orderBy(group).toPandas() if group else None
    return second, first, n, groups


def discrete_percentile(rows: DataFrame, by: list[str], value: str, weight: str, fraction: float) -> DataFrame:
    """First value at which the running weight reaches int(fraction * total)."""
    w = Window.partitionBy(*by)
    merged = rows.groupBy(*by, value).agg(F.sum(weight).alias("__n"))
    upto = merged.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__total", F.sum("__n").over(w))
    return upto.groupBy(*by).agg(F.min(F.when(F.col("__upto") >= F.floor(F.col("__total") * fraction), F.col(value))).alias("percentile"), (F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"), F.sum("__n").alias("total"))


def histogram_difference(rows: DataFrame, by: str, value: str, count: str, kind: str, all_kind: str, less: list[str]) -> DataFrame:
    """The histogram of one kind without those of others."""
    sign = F.when(F.col(kind) == all_kind, F.col(count)).when(F.col(kind).isin(less), -F.col(count)).otherwise(0)
    return rows.groupBy(by, value).agg(F.sum(sign).alias(count)).where(F.col(count) != 0)


def normalised(rows: DataFrame, group: str, value: str, by: str = "sum") -> DataFrame:
    """A value over its group's sum or maximum."""
    w = Window.partitionBy(group)
    return rows.withColumn("share", F.try_divide(F.col(value), (F.sum(value) if by == "sum" else F.max(value)).over(w)))


def class_counts(rows: DataFrame, label: str, n: int) -> DataFrame:
    """Counts of the classes 0 to n - 1, with zeros."""
    found = rows.groupBy(label).agg(F.count("*").alias("__n"))
    return rows.sparkSession.range(n).withColumnRenamed("id", label).join(found, label, "left").select(label, F.coalesce("__n", F.lit(0)).alias("n"))


def cmvn(rows: DataFrame, group: str, order: str, value: str, window: int | None = None, scale: bool = False) -> DataFrame:
    """Mean (and variance) normalisation by group, or in a centred sliding window of frames."""
    w = Window.partitionBy(group)
    if window:
        w = w.orderBy(order).rowsBetween(-(window // 2), window - window // 2 - 1)
    out = F.col(value) - F.avg(value).over(w)
    return rows.withColumn("normed", out / F.sqrt(F.greatest(F.var_pop(value).over(w), F.lit(1e-20))) if scale else out)


def pseudo_groups(rows: DataFrame, group: str, key: str, length: str, members: int, quota: float) -> DataFrame:
    """Split each group into pseudo-groups of at most `members` rows and `quota` length (A27). Greedy, so the rows of a task stream past in order."""
    fields = rows.select(group, key, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row of no group has one of its own before the first.
        last, part, n, total = (), 0, 0, 0.0
        for batch in batches:
            parts = []
            for one, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                x = math.nan if x is None else x
                if one != last:
                    last, part, n, total = one, 0, 0, 0.0
                elif n >= members or total + x > quota:
                    part, n, total = part + 1, 0, 0.0
                n, total = n + 1, total + x
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], names=[*batch.schema.names, "part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema.fields) + ", part int"
    return fields.repartition(group).sortWithinPartitions(group, F.col(key).asc_nulls_last()).mapInArrow(run, schema)


def error_rollup(rows: DataFrame, group: str, counts: list[str]) -> DataFrame:
    """Sums of error counts by group, and over all in a row whose group is 'SUM' (A24)."""
    grouped = rows.rollup(group).agg(*[F.sum(c).alias(c) for c in counts], F.grouping_id().alias("__g"))
    return grouped.withColumn(group, F.when(F.col("__g") == 1, "SUM").otherwise(F.col(group).cast("string"))).drop("__g")


def nested_max(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Per outer key the sum over inner keys of their greatest value."""
    return rows.groupBy(outer, inner).agg(F.max(value).alias("m")).groupBy(outer).agg(F.sum("m").alias("total"))
