"""Structured Streaming: framing with carried-over samples, and event-time windows over an event table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def framed_stream(pieces: DataFrame, key: str, order: str, samples: str, size: int, shift: int) -> DataFrame:
    """Frames of waveforms that arrive in pieces: key, frame, samples; the rest of a piece is kept for the next one."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, rest = state.get if state.exists else (0, [])
        # The state holds plain Python values; the JVM reads no numpy ones.
        done, rest, rows = int(done), [float(x) for x in rest], []
        for piece in pd.concat(list(batches)).sort_values(order)[samples]:
            rest += [float(x) for x in piece]
        while len(rest) >= size:
            rows.append((name[0], done, rest[:size]))
            rest, done = rest[shift:], done + 1
        state.update((done, rest))
        yield pd.DataFrame(rows, columns=[key, "frame", "samples"])

    kind = dict(pieces.dtypes)[key]
    return pieces.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, frame bigint, samples array<double>", "done bigint, rest array<double>", "append", GroupStateTimeout.NoTimeout)


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of events as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums in tumbling or sliding windows of event time; works on tables and on streams."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users that end after a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """For each row on the left the latest value on the right at or before its time, by a union and a running last value."""
    from pyspark.sql import Window

    a = left.select("*", F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(by, at, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("latest", F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").drop("__v", "__side")
