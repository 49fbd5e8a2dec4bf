"""Keyed-table operators over the order tables: a speaker is a supplier or customer, an utterance an order line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyed as k
from ..session import table
from . import query

#: Fixed value: DuckDB's form of functions.arrays.uniform with seed 7.
SQL_U = "(('0x' || substr(md5('7:' || {0}::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def filter_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "supplier").where("s_nationkey = 3")
    return k.filter_keys(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey"), ids, "l_suppkey", "s_suppkey").drop("l_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)")
def filter_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").where("c_acctbal < 5000")
    return k.filter_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), ids, "o_custkey", "c_custkey", exclude=True).drop("o_custkey")


@query("SELECT c_custkey::VARCHAR || s AS key FROM customer, unnest(['', '-reverb', '-noise', '-music', '-babble']) t(s)")
def augmented_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all customers."""
    return k.with_augmented(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key")


@query()
def augmented_keys_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """augmented_keys under its earlier name."""
    return augmented_keys(spark, sf_dir)


@query("SELECT s_nationkey % 3 AS job, l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 6")
def filter_by_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "supplier").where("s_nationkey < 6").select((F.col("s_nationkey") % 3).alias("job"), F.col("s_suppkey").alias("l_suppkey"))
    return k.filter_jobs(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), jobs, "l_suppkey").select("job", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_totalprice >= 50000 AND o_totalprice <= 300000) WHERE n >= 8")
def filter_length_and_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return k.at_least(orders, F.col("o_totalprice"), 50_000, "o_custkey", 8, most=300_000).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, concat_ws('-', o_custkey, o_orderkey) AS key, regexp_replace('sp0.9-' || o_orderkey, '^(sp(?:0\\.9|1\\.1))-(.*)$', '\\2-\\1') AS moved FROM orders")
def key_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    moved = k.speed_to_suffix(F.concat(F.lit("sp0.9-"), F.col("o_orderkey").cast("string")))
    return orders.select("o_orderkey", k.prefixed(F.col("o_orderkey"), F.col("o_custkey").cast("string")).alias("key"), moved.alias("moved"))


@query("SELECT CASE WHEN f = 1.0 THEN doc_id::VARCHAR ELSE 'sp' || f || '-' || doc_id END AS key, round(n_chars / f, 6) AS duration FROM documents, (SELECT unnest([0.9, 1.0, 1.1]::DOUBLE[]) AS f)")
def speed_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").cast("double").alias("duration"))
    return k.speed_copies(docs, "key", "duration").select("key", F.round("duration", 6).alias("duration"))


@query(f"SELECT c_custkey, round(CASE WHEN c_custkey % 4 = 0 THEN 1.5 ELSE 0.5::DOUBLE + {SQL_U.format('c_custkey')} * 1.5::DOUBLE END, 9) AS volume FROM customer")
def volume_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    given = customers.where("c_custkey % 4 = 0").withColumn("volume", F.lit(1.5))
    return k.volume(customers, "c_custkey", given, 0.5, 2.0, seed=7).withColumn("volume", F.round("volume", 9))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return k.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey", strict=True).select("c_custkey", "n_name")


SQL_INTERVALS = """
a AS (SELECT user_id, floor(epoch(ts))::BIGINT AS start, floor(epoch(ts))::BIGINT + 1800 + event_id % 600 AS end_ FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, floor(epoch(ts))::BIGINT AS start, floor(epoch(ts))::BIGINT + 2400 + event_id % 900 AS end_ FROM events WHERE event_type = 'view')"""


def spans(spark: SparkSession, sf_dir: str, kind: str, base: int, spread: int) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    start = F.unix_timestamp("ts")
    return events.select("user_id", start.alias("start"), (start + base + F.col("event_id") % spread).alias("end"))


@query(f"WITH {SQL_INTERVALS} SELECT a.user_id, a.start, a.end_ AS \"end\", b.start AS other_start, b.end_ AS other_end, least(a.end_, b.end_) - greatest(a.start, b.start) AS overlap FROM a JOIN b ON a.user_id = b.user_id AND a.start < b.end_ AND b.start < a.end_")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.overlaps(spans(spark, sf_dir, "click", 1800, 600), spans(spark, sf_dir, "view", 2400, 900), "user_id", 3600)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderstatus")
    tables = {"c": table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "big": orders.where("o_totalprice > 100000"), "open": orders.where("o_orderstatus = 'O'")}
    return k.intersect_keys(tables, "c_custkey")["c"]


@query("SELECT s_suppkey AS key, s_nationkey AS nation, s_suppkey AS origin FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_custkey + 1 FROM customer")
def combine_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") + 1).alias("origin"))
    return k.union_common([s, c], lineage="origin", key="key")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.repeated(table(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey")


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def keys_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"))
    return a.intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("key")))


@query(f"SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {SQL_U.format('c_custkey')}, c_custkey) AS place FROM customer")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", k.shuffled_rank(F.col("c_custkey"), 7, "c_nationkey").cast("bigint").alias("place"))


@query("SELECT p_partkey, ntile(7) OVER (ORDER BY p_partkey)::INT AS part FROM part")
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.split_even(table(spark, sf_dir, "part").select("p_partkey"), 7, "p_partkey")


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) // ceil(count(*) OVER () / 7)::BIGINT + 1)::INT AS part FROM part")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.split_ceil(table(spark, sf_dir, "part").select("p_partkey"), 7, "p_partkey")


SQL_SUMS = "s AS (SELECT s_nationkey AS nation, l_returnflag AS flag, round(sum(l_quantity), 2) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY ALL)"


def flag_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate < TIMESTAMP '1996-01-01'").select("l_suppkey", "l_returnflag", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    return k.lookup(lines, suppliers, "l_suppkey").where("nation is not null").groupBy("nation", F.col("l_returnflag").alias("flag")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))


@query(f"WITH {SQL_SUMS} SELECT nation, coalesce(min(score) FILTER (flag = 'A'), '-inf'::DOUBLE) AS \"A\", coalesce(min(score) FILTER (flag = 'N'), '-inf'::DOUBLE) AS \"N\", coalesce(min(score) FILTER (flag = 'R'), '-inf'::DOUBLE) AS \"R\" FROM s GROUP BY nation")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.pivot_scores(flag_sums(spark, sf_dir), "nation", "flag", ["A", "N", "R"])


@query(f"WITH {SQL_SUMS} SELECT nation, flag, score FROM s")
def score_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.unpivot_scores(k.pivot_scores(flag_sums(spark, sf_dir), "nation", "flag", ["A", "N", "R"]), "nation", "flag")


@query(f"SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {SQL_U.format('o_orderkey')}, o_orderkey) <= 3")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.per_group_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", 3, 7)


@query(f"""WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY {SQL_U.format('o_custkey')}, o_custkey) <= floor(count(*) OVER () * 10 / 100) AS is_valid FROM g)
SELECT o_orderkey, is_valid FROM orders JOIN r USING (o_custkey)""")
def train_valid_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.group_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 10, 7).select("o_orderkey", "is_valid")


@query(f"SELECT p_partkey FROM part QUALIFY row_number() OVER (ORDER BY {SQL_U.format('p_partkey')}, p_partkey) <= floor((SELECT count(*) FROM part) * 0.3)")
def sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.fraction_sample(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 0.3, 7)


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, greatest(1, count(*) OVER (PARTITION BY o_custkey) // 4) AS skip FROM orders)
WHERE (rn - 1) % skip = 0 AND rn <= 4 * skip""")
def every_kth_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.every_kth(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 4)


@query(f"""WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, n FROM g QUALIFY coalesce(sum(n) OVER (ORDER BY {SQL_U.format('o_custkey')}, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500""")
def groups_until_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return k.until_quota(groups, "o_custkey", "n", 500, 7)


@query("SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS class_id FROM customer")
def integer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.class_ids(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "class_id")


@query("""WITH s AS (SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / count(*) OVER (PARTITION BY p_brand) AS share FROM part),
p AS (SELECT *, row_number() OVER (ORDER BY share, p_brand) - 1 AS place FROM s) SELECT p_partkey, place, place // 16 AS block FROM p""")
def proportional_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = k.interleaved(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 16)
    return rows.select("p_partkey", F.col("place").cast("bigint").alias("place"), F.col("block").cast("bigint").alias("block"))


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
