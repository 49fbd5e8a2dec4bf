"""Chunk sampling, batching, signal features, streams and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as s
from ..operators import signal, validate
from ..session import table
from ..streaming import batches as b
from ..streaming import live
from . import query
from .keyed import SQL_U


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")


@query("""WITH n AS (SELECT doc_id, n_chars AS n FROM documents WHERE n_chars >= 400),
c AS (SELECT doc_id, i * 300 AS first, i AS chunk, n FROM n, unnest(range((n - 400) // 300 + 1)) r(i)),
t AS (SELECT doc_id, n - 400, (n - 400) // 300 + 1, n FROM n WHERE (n - 400) % 300 > 0)
SELECT doc_id, chunk::INT AS chunk, first::INT AS first, (first + 399)::INT AS last FROM (SELECT * FROM c UNION ALL SELECT * FROM t)""")
def sequential_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.sequential_chunks(docs(spark, sf_dir), ["doc_id"], "n_chars", 400, 100)


@query(f"""SELECT doc_id, k::INT AS chunk, floor({SQL_U.format("(doc_id || '/' || k)")} * (n_chars - 399))::INT AS first, (floor({SQL_U.format("(doc_id || '/' || k)")} * (n_chars - 399)) + 399)::INT AS last
FROM documents, range(3) r(k) WHERE n_chars >= 400""")
def random_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.random_chunks(docs(spark, sf_dir), ["doc_id"], "doc_id", "n_chars", 400, 3, 7).select("doc_id", "chunk", "first", "last")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents, unnest(range((n_chars - 400) // 200 + 1)) r(i) WHERE n_chars >= 400 GROUP BY source)
SELECT source, (SELECT max(n) FROM c) AS chunks FROM c""")
def balanced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = s.balanced_chunks(docs(spark, sf_dir), "source", "doc_id", "n_chars", 400, 0.5, 7)
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"))


@query("SELECT doc_id, 0 AS chunk, 0::BIGINT AS first, (n_chars // 2) AS last FROM documents UNION ALL SELECT doc_id, 1, n_chars // 2, n_chars FROM documents")
def listed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("n_chars") / 2).cast("string")
    text = F.concat(F.lit("0_"), half, F.lit("#"), half, F.lit("_"), F.col("n_chars").cast("string"))
    return s.listed_chunks(docs(spark, sf_dir).withColumn("c", text), ["doc_id"], "c")


@query(f"""WITH c AS (SELECT * FROM (VALUES ('a', 0.5::DOUBLE), ('b', 0.3), ('c', 0.2)) v(name, p)), u AS (SELECT name, sum(p) OVER (ORDER BY name) / sum(p) OVER () AS hi FROM c)
SELECT doc_id, (SELECT arg_min(name, hi) FROM u WHERE hi > {SQL_U.format('doc_id')}) AS choice FROM documents""")
def weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "name string, p double")
    return s.weighted_pick(docs(spark, sf_dir).select("doc_id"), choices, "doc_id", 7)


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents)
SELECT doc_id, (CASE WHEN (place // 8) % 2 = 0 THEN place % 8 ELSE 7 - place % 8 END)::INT AS bin FROM r""")
def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.bins(docs(spark, sf_dir), "doc_id", "n_chars", 8).select("doc_id", "bin")


@query("""WITH g AS (SELECT source, sum(n_chars) AS size FROM documents GROUP BY source), m AS (SELECT source, sum(size) OVER (ORDER BY source) - size / 2 AS middle, sum(size) OVER () AS total FROM g)
SELECT source, least(floor(middle * 4 / total), 3)::INT AS part FROM m""")
def parts_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("size"))
    return s.group_parts(groups, "source", "size", 4).select("source", "part")


@query("SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, ntile(37) OVER (ORDER BY doc_id) AS p FROM documents) GROUP BY p")
def evenly_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.spread(docs(spark, sf_dir), "doc_id", 37)


@query(f"WITH r AS (SELECT n_chars, (row_number() OVER (ORDER BY {SQL_U.format('doc_id')}, doc_id) - 1) // 64 AS shard FROM documents) SELECT shard, sum(n_chars)::BIGINT AS length, count(*) AS rows FROM r GROUP BY shard")
def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.manifest(s.shards(docs(spark, sf_dir), "doc_id", 64, 7), "n_chars")


@query()
def noise_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.noise_assignment(docs(spark, sf_dir), [("a", 300.0), ("b", 700.0), ("c", 150.0)], "doc_id", "n_chars", [5.0, 10.0, 15.0], 7)


@query()
def archive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.archive_plan(docs(spark, sf_dir), "source", 5, 100, 400, 8, 7)


@query(f"WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {SQL_U.format('doc_id')}, doc_id) - 1 AS place FROM documents) SELECT doc_id, place % 4 AS rank, (place // 4) % 2 AS worker FROM p")
def distributed_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.distributed(docs(spark, sf_dir), "doc_id", 4, 2, 7)
    return rows.select("doc_id", F.col("rank").cast("bigint").alias("rank"), F.col("worker").cast("bigint").alias("worker"))


@query("""WITH b AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS g FROM documents)
SELECT doc_id, g * 100 + row_number() OVER (PARTITION BY g ORDER BY n_chars, doc_id) - 1 AS place FROM b""")
def buffered_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.buffered_order(docs(spark, sf_dir), "doc_id", "doc_id", 100, by="n_chars").select("doc_id", F.col("place").cast("bigint").alias("place"))


@query("WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents) SELECT batch, string_agg(doc_id, ' ' ORDER BY doc_id) AS ids FROM b GROUP BY batch")
def static_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.static_batches(docs(spark, sf_dir), "doc_id", 16)
    return rows.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), " ").alias("ids"))


@query()
def dynamic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.dynamic_batches(docs(spark, sf_dir), "source", "doc_id", "n_chars", 20_000)


@query("""WITH v AS (SELECT vec_id, label, embedding[1:1 + vec_id % 8]::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(len(v) / max(len(v)) OVER (PARTITION BY label), 9) AS valid, round(list_sum(v), 6) AS total, max(len(v)) OVER (PARTITION BY label)::INT AS size FROM v""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr("slice(cast(embedding as array<double>), 1, cast(1 + vec_id % 8 as int))").alias("v"))
    out = b.padded(rows, ["label"], "v")
    return out.select("vec_id", F.round("valid", 9).alias("valid"), F.round(F.aggregate("v", F.lit(0.0), lambda x, y: x + y), 6).alias("total"), F.size("v").alias("size"))


@query("SELECT doc_id, CASE WHEN n_chars < 400 THEN 0 ELSE 1 + (n_chars - 400) // 160 END::INT AS snipped, ((n_chars + 80) // 160)::INT AS whole FROM documents")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return docs(spark, sf_dir).select("doc_id", signal.num_frames(n, 400, 160).alias("snipped"), signal.num_frames(n, 400, 160, snip=False).alias("whole"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))


@query("""WITH f AS (SELECT vec_id, i AS frame, embedding[i * 8 + 1:i * 8 + 16]::DOUBLE[] AS x FROM embeddings, range(7) r(i)),
p AS (SELECT vec_id, frame, [x[k] - 0.97::DOUBLE * x[greatest(k - 1, 1)] FOR k IN range(1, 17)] AS y FROM f),
h AS (SELECT vec_id, frame, [y[k] * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() / 15 * (k - 1))) FOR k IN range(1, 17)] AS z FROM p)
SELECT vec_id, frame::INT AS frame, round(ln(greatest(list_inner_product(z, z), 1e-10)), 5) AS log_energy FROM h""")
def frame_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = waves(spark, sf_dir).select("vec_id", F.posexplode(signal.frames(F.col("w"), 16, 8)).alias("frame", "x"))
    z = signal.windowed(signal.preemphasis(F.col("x")), "hamming", 16)
    return frames.select("vec_id", "frame", F.round(signal.log_energy(z), 5).alias("log_energy"))


@query()
def mel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = waves(spark, sf_dir).select("vec_id", signal.fbank(F.col("w"), rate=1000.0, bins=8, ceps=4).alias("c"))
    return rows.select("vec_id", *[F.round(F.element_at("c", i + 1), 4).alias(f"c{i}") for i in range(4)])


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 64, 6) AS mean, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS peak FROM embeddings")
def amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return waves(spark, sf_dir).select("vec_id", F.round(signal.amplitude(w), 6).alias("mean"), F.round(signal.amplitude(w, "peak"), 6).alias("peak"))


@query("""SELECT 'unique' AS rule, l_orderkey::VARCHAR AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
UNION ALL SELECT 'missing on the right', c_custkey::VARCHAR, '' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'missing on the left', o_custkey::VARCHAR, '' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'positive c_acctbal', c_custkey::VARCHAR, NULL FROM customer WHERE c_acctbal <= 0""")
def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    negative = validate.positive(customer, "c_custkey", "c_acctbal").withColumn("detail", F.lit(None).cast("string"))
    return validate.all_of(validate.unique(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey"), validate.same_keys(customer.select("c_custkey"), orders, "c_custkey"), negative)


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.sessions(table(spark, sf_dir, "events"))


@query("""SELECT p.event_id, (SELECT arg_max(v.value, struct_pack(t := v.ts, e := v.event_id)) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts) AS latest
FROM events p WHERE p.event_type = 'purchase'""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return live.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "value").select("event_id", "latest")
