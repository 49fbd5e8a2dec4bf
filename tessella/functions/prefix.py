"""Running sums over a whole table, in order, without putting its rows into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned


def placed(df: DataFrame, order: list[Column], name: str = "__place") -> DataFrame:
    """df with the place (from 0) of each row in the given order, which should be total."""
    return running_sums(df, order, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) - 1)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """df with a column for each of `sums`: its sum over all rows up to this one in the given order.

    Rows are dealt by ranges of the order; each range's totals are added up over the ranges (one row a
    range) and then within each range. The order should be total, as ties are split arbitrarily.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = {k: f"__v_{k}" for k in sums}
    ranged = df.withColumns({names[k]: v for k, v in sums.items()}).repartitionByRange(n, *order)
    ranged = pinned(ranged.withColumn("__part", F.spark_partition_id()))
    ranges = ranged.groupBy("__part").agg(*[F.sum(names[k]).alias(names[k]) for k in sums])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col("__part").alias("__of"), *[F.coalesce(F.sum(names[k]).over(earlier), F.lit(0)).alias(f"__o_{k}") for k in sums])
    upto = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))  # a row a partition
    return joined.withColumns({k: F.sum(names[k]).over(upto) + F.col(f"__o_{k}") for k in sums}).drop("__part", "__of", *names.values(), *[f"__o_{k}" for k in sums])
