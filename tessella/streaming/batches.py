"""Batching of records: bounded shuffles and sorts, static and dynamic batches, padding, distribution."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import uniform
from ..functions.prefix import placed


def pipeline(rows: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stages one after the other."""
    for stage in stages:
        rows = rows.transform(stage)
    return rows


def distributed(rows: DataFrame, key: str, world: int, workers: int, epoch: int) -> DataFrame:
    """rank and worker of each row in the shuffle of an epoch (R2)."""
    place = F.col("__place")
    return placed(rows, [uniform(F.col(key), epoch), F.col(key)]).withColumn("rank", place % world).withColumn("worker", F.floor(place / world) % workers).drop("__place")


def buffered_order(rows: DataFrame, order: str, key: str, buffer: int, by: str | None = None, seed: int = 0) -> DataFrame:
    """place: rows shuffled, or sorted by a column, within buffers of consecutive rows."""
    rows = placed(rows, [F.col(order)]).withColumn("__buffer", F.floor(F.col("__place") / buffer)).drop("__place")
    inner = [F.col(by), F.col(key)] if by else [uniform(F.col(key), seed), F.col(key)]
    inside = F.row_number().over(Window.partitionBy("__buffer").orderBy(*inner)) - 1
    return rows.withColumn("place", F.col("__buffer") * buffer + inside).drop("__buffer")


def static_batches(rows: DataFrame, order: str, n: int) -> DataFrame:
    """batch: every n rows in order."""
    return placed(rows, [F.col(order)]).withColumn("batch", F.floor(F.col("__place") / n)).drop("__place")


def dynamic_batches(rows: DataFrame, part: str, order: str, length: str, most: int) -> DataFrame:
    """batch within each part: a batch closes when the longest row times the rows would go over `most`."""
    fields = {f.name: f.dataType.simpleString() for f in rows.select(part, order, length).schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        batch, longest, n, out = 0, 0, 0, []
        for x in pdf[length]:
            if n and max(longest, x) * (n + 1) > most:
                batch, longest, n = batch + 1, 0, 0
            longest, n = max(longest, x), n + 1
            out.append(batch)
        return pdf.assign(batch=out)

    return rows.select(part, order, length).groupBy(part).applyInPandas(run, ", ".join(f"{k} {v}" for k, v in fields.items()) + ", batch int")


def padded(rows: DataFrame, batch: list[str], values: str, fill: float = 0.0) -> DataFrame:
    """Arrays filled up to the longest of their batch, with the share that is valid."""
    longest = F.max(F.size(values)).over(Window.partitionBy(*batch))
    n = F.size(values)
    return rows.withColumn("__m", longest).withColumn("valid", n / F.col("__m")).withColumn(values, F.concat(values, F.array_repeat(F.lit(fill), F.col("__m") - n))).drop("__m")


def quota_filter(rows: DataFrame, length: str, least: float, most: float, values: str | None = None, cut: int | None = None) -> DataFrame:
    """Rows of a fitting length; of longer ones, with cut, the first `cut` elements of the array `values` (F8)."""
    if cut is None:
        return rows.where(F.col(length).between(least, most))
    long = F.col(length) > most
    out = rows.where(F.col(length) >= least).withColumn("__long", long)
    return out.withColumn(values, F.when(F.col("__long"), F.slice(values, 1, cut)).otherwise(F.col(values))).withColumn(length, F.when(F.col("__long"), F.least(F.col(length), F.lit(cut))).otherwise(F.col(length))).drop("__long")
