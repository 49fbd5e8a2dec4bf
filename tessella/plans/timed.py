"""Segments over `events` and `documents`: a recording is a user or a document, its time in seconds or characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments as s
from ..session import table
from . import query
from .keyed import SQL_INTERVALS, spans


@query("""WITH d AS (SELECT doc_id, 0.0::DOUBLE AS s, n_chars / 100.0::DOUBLE AS e FROM documents),
n AS (SELECT *, greatest(0, floor((e - s - 1.5::DOUBLE - 0.5::DOUBLE) / 1.0 + 1e-9) + 1)::INT AS n FROM d)
SELECT doc_id, i::INT AS piece, round(s + i * 1.0, 6) AS sub_start, round(CASE WHEN i = n THEN e ELSE s + i * 1.0 + 1.5::DOUBLE END, 6) AS sub_end
FROM n, unnest(range(n + 1)) r(i) WHERE CASE WHEN i = n THEN e ELSE s + i * 1.0 + 1.5::DOUBLE END > s + i * 1.0""")
def uniform_subsegments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0.0).alias("s"), (F.col("n_chars") / 100).alias("e"))
    rows = s.uniform(docs, ["doc_id"], "s", "e", most=1.5, overlap=0.5, remaining=0.5)
    return rows.select("doc_id", "piece", F.round("sub_start", 6).alias("sub_start"), F.round("sub_end", 6).alias("sub_end"))


@query("""WITH n AS (SELECT doc_id, n_chars, (n_chars // 300)::INT AS n FROM documents)
SELECT doc_id, (i * 300)::DOUBLE AS start, ((i + 1) * 300)::DOUBLE AS "end" FROM n, unnest(range(n)) r(i)
UNION ALL SELECT doc_id, (n_chars - 300)::DOUBLE, n_chars::DOUBLE FROM n WHERE n > 0 AND n_chars - n * 300 > 150""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.fixed_chunks(table(spark, sf_dir, "documents"), ["doc_id"], "n_chars", 300.0)


@query()
def padded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir, "click", 1800, 600)
    rows = rows.select("user_id", F.col("start").alias("key"), F.col("start").cast("double"), F.col("end").cast("double"))
    return s.padded(rows, "user_id", "key", 900.0, 900.0)


@query()
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spans(spark, sf_dir, "click", 1800, 600).select("user_id", F.lit(1).alias("label"), F.col("start").cast("double"), F.col("end").cast("double"))
    return s.merged_speech(runs, "user_id", "label", 1, 1900.0, 300.0, 1200.0, 20_000.0)


@query()
def overlaps_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir, "view", 20_000, 9000).select("user_id", F.col("start").alias("key"), F.col("start").cast("double"), F.col("end").cast("double"))
    return s.cut_overlaps(rows, "user_id", "key")


@query()
def combined_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").cast("double").alias("length"))
    return s.combined(docs, "source", "doc_id", "length", 1500.0)


@query()
def combined_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order, and orders whose items are too few together with their neighbours."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_quantity").cast("double").alias("length"))
    return s.combined_across(items, "group", "key", "length", 60.0)


@query()
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders that share a part, one after the other."""
    return linked_orders(table(spark, sf_dir, "lineitem"))


@query()
def connected_components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """connected_components under its earlier name."""
    return connected_components(spark, sf_dir)


def linked_orders(lines: DataFrame) -> DataFrame:
    """node, label: the smallest order that shared parts reach, for every order."""
    lines = lines.select("l_orderkey", "l_partkey")
    first = lines.groupBy("l_partkey").agg(F.min("l_orderkey").alias("first"))
    edges = lines.join(first, "l_partkey").select(F.col("l_orderkey").alias("u"), F.col("first").alias("v"))
    return s.components(edges, "u", "v")


@query(f"""WITH {SQL_INTERVALS}, o AS (SELECT sum(least(a.end_, b.end_) - greatest(a.start, b.start)) AS overlap FROM a JOIN b ON a.user_id = b.user_id AND a.start < b.end_ AND b.start < a.end_),
f AS (SELECT sum(end_ - start) AS found, count(*) FILTER (end_ - start < 0.2) AS n_short, count(*) FILTER (end_ - start > 60) AS n_long FROM a), r AS (SELECT sum(end_ - start) AS reference FROM b)
SELECT found::BIGINT AS found, reference::BIGINT AS reference, overlap::BIGINT AS overlap, (found - overlap)::BIGINT AS false_alarm, (reference - overlap)::BIGINT AS missed, n_short, n_long FROM f, r, o""")
def segmentation_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.evaluation(spans(spark, sf_dir, "click", 1800, 600), spans(spark, sf_dir, "view", 2400, 900), "user_id", 3600)


@query("""WITH r AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, i FROM r, range(240) t(i)),
s AS (SELECT user_id, (floor(epoch(ts))::BIGINT % 864000) // 3600 AS a, (floor(epoch(ts))::BIGINT % 864000) // 3600 + 2 AS b FROM events WHERE event_type = 'click')
SELECT g.user_id, string_agg((EXISTS (SELECT 1 FROM s WHERE s.user_id = g.user_id AND a <= i AND i < b))::INT::VARCHAR, '' ORDER BY i) AS mask FROM g GROUP BY g.user_id""")
def frame_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_timestamp("ts") % 864_000 / 3600)
    clicks = events.where("event_type = 'click'").select("user_id", hour.alias("start"), (hour + 2).alias("end"))
    users = events.select("user_id").distinct().withColumn("frames", F.lit(240))
    return s.frame_mask(clicks, users, "user_id", "frames", 1.0).select("user_id", F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"))


@query("SELECT e.event_id, e.user_id AS reco, e.event_id % 50 + u.first AS start, e.event_id % 50 + u.first + 5 AS \"end\" FROM events e JOIN (SELECT user_id, min(floor(epoch(ts))::BIGINT) AS first FROM events GROUP BY user_id) u USING (user_id)")
def nested_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    parents = events.groupBy("user_id").agg(F.min(F.unix_timestamp("ts")).alias("start")).withColumn("reco", F.col("user_id"))
    subs = events.select("event_id", "user_id", (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + 5).alias("end"))
    return s.nested(subs, parents, "user_id").select("event_id", "reco", "start", "end")


@query("SELECT round(sum(n_chars / 100.0::DOUBLE) / sum(n_chars), 9) AS frame_shift FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 10)")
def frame_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 100).alias("length"), "n_chars")
    return s.frame_shift(docs, "doc_id", "length", "n_chars").select(F.round("frame_shift", 9).alias("frame_shift"))


@query("SELECT doc_id AS utt, doc_id AS reco, 0.0::DOUBLE AS start, n_chars::DOUBLE AS \"end\" FROM documents")
def whole_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.default_segments(table(spark, sf_dir, "documents"), "doc_id", "n_chars")


@query("SELECT vec_id, round(list_sum(list_transform([list_sum(list_transform(embedding[i:i + 7], lambda x: abs(x::DOUBLE))) / 8 > 0.8 FOR i IN range(1, 65, 8)], lambda b: b::INT)), 6)::BIGINT * 8 AS kept FROM embeddings")
def loud_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("wave"))
    return rows.select("vec_id", F.size(s.loud_windows(F.col("wave"), 8, 0.8)).cast("bigint").alias("kept"))
