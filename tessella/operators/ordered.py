"""Windows over ordered rows: ranks, runs, votes, framing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(rows: DataFrame, by: list[str], score: str, tie: str, n: int) -> DataFrame:
    """The n rows of greatest score in each group, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def top_lists(rows: DataFrame, by: str, score: str, item: str, n: int = 10) -> DataFrame:
    """by -> its n best items in order."""
    best = top_n(rows, [by], score, item, n)
    return best.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("items"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key (W6). Partial minima are merged, so a frequent key is no large group."""
    others = [c for c in rows.columns if c not in (key, order)]
    first = rows.groupBy(key).agg(F.min(F.struct(order, *others)).alias("f"))
    return first.select(key, f"f.{order}", *[f"f.{c}" for c in others])


def thin_repeats(rows: DataFrame, text: str, keep: Column, most: int) -> DataFrame:
    """Rows of texts seen at most `most` times; of others a share of most / count, by the uniform draw `keep`."""
    counts = rows.groupBy(text).agg(F.count("*").alias("__n"))
    return rows.join(counts, text).where((F.col("__n") <= most) | (keep < most / F.col("__n"))).drop("__n")


def duration_grid(rows: DataFrame, length: str, factor: float, low: float, high: float) -> list[float]:
    """A geometric grid of lengths between two quantiles."""
    lo, hi = rows.select(F.percentile(length, [low, high])).first()[0]
    grid = [lo]
    while grid[-1] * factor < hi * factor:
        grid.append(grid[-1] * factor)
    return grid


def nearest_length(rows: DataFrame, length: str, grid: list[float]) -> DataFrame:
    """For each row the grid lengths just below and above its own."""
    points = F.array(*[F.lit(float(x)) for x in grid])
    below = F.array_max(F.filter(points, lambda x: x <= F.col(length)))
    above = F.array_min(F.filter(points, lambda x: x > F.col(length)))
    return rows.withColumn("below", below).withColumn("above", above)


def islands(rows: DataFrame, group: str, order: str, label: str) -> DataFrame:
    """Run-length encoding: group, run, label, first, last, n."""
    w = Window.partitionBy(group).orderBy(order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    runs = rows.withColumn("__c", change).withColumn("run", F.sum("__c").over(w))
    return runs.groupBy(group, "run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def sliding_vote(rows: DataFrame, group: str, order: str, hit: Column, context: int, share: float) -> DataFrame:
    """Whether enough of the frames around each one are hits."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-context, context)
    return rows.withColumn("voted", (F.avg(hit.cast("double")).over(w) >= share).cast("int"))


def block_average(rows: DataFrame, group: str, frame: str, value: str, n: int) -> DataFrame:
    """Means of every n frames."""
    return rows.groupBy(group, F.floor(F.col(frame) / n).alias("block")).agg(F.avg(value).alias("mean"))


def deltas(rows: DataFrame, group: str, order: str, value: str, reach: int = 2) -> DataFrame:
    """Regression deltas over `reach` frames on both sides, the edge frames standing for those beyond."""
    w = Window.partitionBy(group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    ahead = lambda k: F.coalesce(F.lead(value, k).over(w), last)
    back = lambda k: F.coalesce(F.lag(value, k).over(w), first)
    top = sum((k * (ahead(k) - back(k)) for k in range(2, reach + 1)), ahead(1) - back(1))
    return rows.withColumn("delta", top / (2 * sum(k * k for k in range(1, reach + 1))))


def bookends(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The values before and after each row."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("following", F.lead(value).over(w))


def around_best(rows: DataFrame, query: str, place: str, score: str, reach: int, factor: float) -> DataFrame:
    """The best row of each query and its neighbours by place whose score is at least factor times as good."""
    best = rows.groupBy(query).agg(F.max_by(F.struct(F.col(place).alias("at"), F.col(score).alias("top")), F.struct(F.col(score), -F.col(place))).alias("best"))
    joined = rows.join(best, query)
    return joined.where((F.abs(F.col(place) - F.col("best.at")) <= reach) & (F.col(score) >= factor * F.col("best.top"))).drop("best")
