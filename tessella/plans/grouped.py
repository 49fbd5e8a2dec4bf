"""Grouped statistics and ordered windows over `orders`, `lineitem`, `documents` and `events` (a recording is a user)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import uniform
from ..operators import aggregates as a
from ..operators import ordered as o
from ..session import table
from . import query
from .keyed import SQL_U


@query("SELECT o_custkey, string_agg(o_orderkey, ' ' ORDER BY o_orderkey) AS members FROM orders GROUP BY o_custkey")
def group_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = a.to_lists(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return lists.select("o_custkey", F.array_join(F.col("members").cast("array<string>"), " ").alias("members"))


@query("SELECT o_custkey, o_orderkey FROM orders")
def list_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = a.to_lists(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return a.from_lists(lists, "o_custkey", "o_orderkey")


@query("SELECT user_id, string_agg(event_id, ' ' ORDER BY ts, event_id) AS members FROM events GROUP BY user_id")
def recording_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("start"), F.col("event_id").alias("end"))
    return a.timed_lists(rows, "user_id", "start", "end", "event_id").select("user_id", F.array_join(F.col("members").cast("array<string>"), " ").alias("members"))


@query("SELECT count(*) AS n_utts, count(DISTINCT source) AS n_spks, sum(n_chars)::BIGINT AS frames, round(sum(n_chars) / 360000.0, 6) AS hours FROM documents")
def dataset_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.attributes(table(spark, sf_dir, "documents"), "source", F.col("n_chars")).withColumn("hours", F.round("hours", 6))


@query("SELECT sum(n_chars)::BIGINT AS total, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, arg_min(doc_id, struct_pack(l := n_chars, k := doc_id)) AS least_key, max(n_chars) AS most, arg_min(doc_id, struct_pack(l := -n_chars, k := doc_id)) AS most_key FROM documents")
def length_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.extremes(table(spark, sf_dir, "documents"), "doc_id", F.col("n_chars")).withColumn("mean", F.round("mean", 6))


@query("SELECT l_suppkey, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def group_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.moments(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return rows.select("l_suppkey", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


SQL_DIMS = "WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query(SQL_DIMS + ", m AS (SELECT label, i, sum(x * (1 + vec_id % 3)) / sum(1 + vec_id % 3) AS m, count(*) AS n FROM d GROUP BY label, i) SELECT label, round(sum(m), 6) AS total, round(max(m), 6) AS most, max(n) AS n FROM m GROUP BY label")
def weighted_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding", 1 + F.col("vec_id") % 3)
    return rows.select("label", F.round(F.aggregate("mean", F.lit(0.0), lambda x, y: x + y), 6).alias("total"), F.round(F.array_max("mean"), 6).alias("most"), "n")


@query(SQL_DIMS + ", m AS (SELECT label, i, avg(x) AS m, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-10)) AS s FROM d GROUP BY label, i) SELECT label, round(sum(m), 6) AS means, round(sum(s), 6) AS deviations FROM m GROUP BY label")
def statistics_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.pooled(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda x, y: x + y), 6)
    return rows.select("label", total(F.slice("stats", 1, 64)).alias("means"), total(F.slice("stats", 65, 64)).alias("deviations"))


@query("""WITH m AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS upto, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM m)
SELECT l_returnflag, min(l_quantity) FILTER (upto >= floor(total * 0.95)) AS percentile, round(sum(l_quantity * n) / sum(n), 6) AS mean, sum(n)::BIGINT AS total FROM u GROUP BY l_returnflag""")
def weighted_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.lit(1).alias("w"))
    return a.discrete_percentile(rows, ["l_returnflag"], "l_quantity", "w", 0.95).withColumn("mean", F.round("mean", 6))


@query("SELECT l_linestatus, l_quantity, sum(CASE WHEN l_returnflag = 'N' THEN 1 WHEN l_returnflag IN ('A', 'R') THEN -1 ELSE 0 END)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING sum(CASE WHEN l_returnflag = 'N' THEN 1 WHEN l_returnflag IN ('A', 'R') THEN -1 ELSE 0 END) <> 0")
def histogram_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity", "l_returnflag", F.lit(1).cast("bigint").alias("n"))
    return a.histogram_difference(rows, "l_linestatus", "l_quantity", "n", "l_returnflag", "N", ["A", "R"])


@query("SELECT p_partkey, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 9) AS share FROM part")
def share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.normalised(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").select("p_partkey", F.round("share", 9).alias("share"))


@query("SELECT r.i AS label, count(e.label) AS n FROM range(12) r(i) LEFT JOIN embeddings e ON e.label = r.i GROUP BY r.i")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.class_counts(table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("label")), "label", 12)


@query("""SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 9) AS normed,
round(value - avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), 9) AS sliding FROM events""")
def mean_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.struct("ts", "event_id").alias("at"))
    whole = a.cmvn(events, "user_id", "at", "value").withColumnRenamed("normed", "whole")
    return a.cmvn(whole, "user_id", "at", "value", window=30).select("event_id", F.round("whole", 9).alias("normed"), F.round("normed", 9).alias("sliding"))


@query("SELECT coalesce(o_orderstatus, 'SUM') AS o_orderstatus, sum(c)::BIGINT AS high, sum(t)::BIGINT AS n FROM (SELECT o_orderstatus, (o_orderpriority = '1-URGENT')::INT AS c, 1 AS t FROM orders) GROUP BY ROLLUP (o_orderstatus)")
def error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("high"), F.lit(1).alias("n"))
    return a.error_rollup(rows, "o_orderstatus", ["high", "n"])


@query("SELECT l_returnflag, round(sum(m), 2) AS total FROM (SELECT l_returnflag, l_suppkey, max(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def nested_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.nested_max(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", "l_quantity").withColumn("total", F.round("total", 2))


@query()
def pseudo_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy quotas have no closed form; tests hold them against a loop."""
    return a.pseudo_groups(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice", 5, 800_000.0)


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.top_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey", 3).drop("o_totalprice")


@query("SELECT user_id, arg_min(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY user_id")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    return o.first_seen(events, "user_id", "at").select("user_id", "event_type")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) USING (l_partkey) WHERE n <= 25 OR {SQL_U.format('(l_orderkey * 10 + l_linenumber)')} < 25.0::DOUBLE / n")
def thinned_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return o.thin_repeats(rows, "l_partkey", uniform(F.col("l_orderkey") * 10 + F.col("l_linenumber"), 7), 25).select("l_orderkey", "l_linenumber")


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS g FROM e)
SELECT user_id, event_type, min(pos)::INT AS first, max(pos)::INT AS last, count(*) AS n FROM r GROUP BY user_id, event_type, g""")
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", at.alias("at"))
    return o.islands(rows, "user_id", "at", "event_type").drop("run")


@query("SELECT event_id, (avg((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) >= 0.6)::INT AS voted FROM events")
def sliding_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.struct("ts", "event_id").alias("at"))
    return o.sliding_vote(events, "user_id", "at", F.col("value") > 50, 5, 0.6).select("event_id", "voted")


@query("SELECT user_id, event_id // 100 AS block, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def block_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.block_average(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 100).withColumn("mean", F.round("mean", 6))


@query("""WITH e AS (SELECT *, first_value(value) OVER w AS f, last_value(value) OVER w AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, round((coalesce(lead(value, 1) OVER w, l) - coalesce(lag(value, 1) OVER w, f) + 2 * (coalesce(lead(value, 2) OVER w, l) - coalesce(lag(value, 2) OVER w, f))) / 10, 6) AS delta
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def regression_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.struct("ts", "event_id").alias("at"))
    return o.deltas(events, "user_id", "at", "value").select("event_id", F.round("delta", 6).alias("delta"))


@query("SELECT event_id, lag(event_type) OVER w AS previous, lead(event_type) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return o.bookends(events, "user_id", "at", "event_type").select("event_id", "previous", "following")


@query("""WITH b AS (SELECT user_id, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS best, max(value) AS top FROM events GROUP BY user_id)
SELECT e.user_id, event_id FROM events e JOIN b ON e.user_id = b.user_id WHERE abs(event_id - best) <= 500 AND value >= 0.8 * top""")
def around_the_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.around_best(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 500, 0.8).select("user_id", "event_id")


@query("""WITH g AS (SELECT unnest([50.0::DOUBLE, 100, 200, 400, 800, 1600, 3200]) AS x)
SELECT doc_id, (SELECT max(x) FROM g WHERE x <= n_chars) AS below, (SELECT min(x) FROM g WHERE x > n_chars) AS above FROM documents""")
def allowed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.nearest_length(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", [50.0 * 2**k for k in range(7)]).select("doc_id", "below", "above")
