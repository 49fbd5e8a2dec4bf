"""Words with times and edits, and what goes with them, over made-up utterances: a user is one, the events are the words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cleanup, decodes
from ..operators import edits as e
from ..operators import segments as s
from ..operators import text as t
from ..session import table
from . import query

SQL_EDITS = """edits AS (
  SELECT utt, place,
         CASE kind WHEN 2 THEN '<unk>' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'w' || word % 4 END AS hyp_word,
         CASE kind WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 'w' || (word + 1) % 4 ELSE 'w' || word % 4 END AS ref_word,
         CASE kind WHEN 3 THEN 'sil' WHEN 4 THEN 'del' WHEN 5 THEN 'ins' WHEN 6 THEN 'sub' ELSE 'cor' END AS edit
  FROM (SELECT user_id AS utt, event_id AS place, event_id * 31 % 101 % 7 AS kind, event_id * 17 % 13 AS word FROM events))"""


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), F.col("event_id").alias("place"))
    kind, word = F.col("place") * 31 % 101 % 7, lambda by: F.concat(F.lit("w"), ((F.col("place") * 17 % 13 + by) % 4).cast("string"))
    return rows.select(
        "utt",
        "place",
        F.when(kind == 2, "<unk>").when(kind.isin(3, 4), None).otherwise(word(0)).alias("hyp_word"),
        F.when(kind.isin(3, 5), None).when(kind == 6, word(1)).otherwise(word(0)).alias("ref_word"),
        F.when(kind == 3, "sil").when(kind == 4, "del").when(kind == 5, "ins").when(kind == 6, "sub").otherwise("cor").alias("edit"),
    )


@query(f"""WITH {SQL_EDITS}, c AS (SELECT *, edit IN ('sil', 'fix') OR (edit = 'cor' AND hyp_word IS DISTINCT FROM ref_word) AS can FROM edits),
m AS (SELECT *, CASE WHEN NOT can THEN edit IN ('del', 'sub', 'ins') END AS stop FROM c),
n AS (SELECT *, coalesce(last_value(stop IGNORE NULLS) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR coalesce(first_value(stop IGNORE NULLS) OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS hit,
      coalesce(lag(can) OVER b, false) OR coalesce(lead(can) OVER b, false) AS near
      FROM m WINDOW b AS (PARTITION BY utt ORDER BY place))
SELECT utt, place, edit, can AND hit AS tainted FROM n WHERE NOT (edit = 'del' AND near)""")
def tainted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.tainted(edited(spark, sf_dir)).select("utt", "place", "edit", "tainted")


@query(f"""WITH {SQL_EDITS}, x AS (SELECT *, coalesce(hyp_word IN ('w0', 'w1'), false) AS h, coalesce(ref_word IN ('w0', 'w1'), false) AS r FROM edits),
f AS (SELECT *, (edit = 'ins' AND h) OR (edit = 'sub' AND h AND r) AS fixed FROM x WHERE NOT (edit = 'del' AND r))
SELECT utt, place, hyp_word, CASE WHEN fixed THEN hyp_word ELSE ref_word END AS ref_word, CASE WHEN fixed THEN 'fix' ELSE edit END AS edit FROM f""")
def scored_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.without_unscored(edited(spark, sf_dir), spark.createDataFrame([("w0",), ("w1",)], "word string"))


@query()
def repeated_words_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.repetitions_allowed(edited(spark, sf_dir), spark.createDataFrame([("w0",)], "word string"))


def timed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits with taint and times: of some hundredths each, one after the other; 'w3' is a word that does not count."""
    at = Window.partitionBy("utt").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(F.col("edit") == "del", 0).otherwise(F.col("place") * 13 % 67 + 3)
    rows = e.tainted(edited(spark, sf_dir), remove_deletions=False).withColumn("__n", size).withColumn("__upto", F.sum("__n").over(at))
    return rows.select("utt", "place", ((F.col("__upto") - F.col("__n")) / 100).alias("start"), (F.col("__n") / 100).alias("dur"), "hyp_word", "ref_word", "edit", "tainted")


LOOSE = cleanup.Limits(least=0.3, least_new=0.5, edge_silence=0.2, edge_unscored=0.2, inner_silence=0.6, inner_unscored=0.6, junk=0.4)


@query()
def segments_from_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleanup.segments_from_edits(timed_edits(spark, sf_dir), spark.createDataFrame([("w3",)], "word string"), LOOSE)
    return rows.select("utt", "segment", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "text")


@query()
def words_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed_edits(spark, sf_dir)
    return cleanup.words_lost(rows, cleanup.segments_from_edits(rows, spark.createDataFrame([("w3",)], "word string"), LOOSE))


@query()
def segments_from_decodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a recording; each event is a run of 1 to 89 frames of silence, noise or speech."""
    kind = F.col("event_id") * 7919 % 10
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), F.col("event_id"), F.when(kind < 5, 0).when(kind < 6, 1).otherwise(2).alias("label"), (F.col("event_id") * 31 % 89 + 1).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("recording").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return decodes.segments_from_decodes(rows.select("recording", (upto - F.col("n")).alias("start"), upto.alias("end"), "label"), most=5.0, hard_most=8.0)


@query(f"""WITH {SQL_EDITS}, u AS (SELECT utt, utt % 5 AS speaker, max((edit <> 'cor')::INT) AS wrong FROM edits GROUP BY utt)
SELECT speaker, count(*) AS sentences, sum(wrong)::BIGINT AS wrong, round(sum(wrong) / count(*), 9) AS ser FROM u GROUP BY speaker""")
def sentence_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.sentence_errors(edited(spark, sf_dir).withColumn("speaker", F.col("utt") % 5), "utt", ["speaker"])
    return rows.withColumn("ser", F.round("ser", 9))


@query("""WITH w AS (SELECT user_id AS utt, event_id AS start, event_type AS word, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events)
SELECT utt, start, word, CASE WHEN start % 3 = 0 THEN 'S' ELSE 'C' END AS op FROM w""")
def words_with_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events and their outcomes; the outcomes go on for one place more, which has no word."""
    words = table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), F.col("event_id").alias("start"), F.col("event_type").alias("word"))
    place = F.row_number().over(Window.partitionBy("utt").orderBy("start")) - 1
    outcomes = words.select("utt", place.alias("place"), F.when(F.col("start") % 3 == 0, "S").otherwise("C").alias("op"), F.col("word").alias("hyp_word"))
    outcomes = outcomes.unionByName(words.groupBy("utt").agg(F.count("*").cast("int").alias("place"), F.lit("I").alias("op"), F.lit("more").alias("hyp_word")))
    return e.with_outcomes(words, outcomes)


@query("""SELECT vec_id AS utt, w, round(ln(list_avg(d[round_even(100 * start, 0)::INT + 1:round_even(100 * (start + dur), 0)::INT])), 6) AS log_depth
FROM (SELECT vec_id, w, list_transform(embedding, lambda x: 1 + abs(x::DOUBLE)) AS d, w * 0.015::DOUBLE AS start, 0.01::DOUBLE * (2 + (vec_id + w) % 4) AS dur FROM embeddings, unnest([0, 1, 2]) t(w))""")
def words_with_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings")
    depths = vec.select(F.col("vec_id").alias("utt"), F.transform(F.col("embedding").cast("array<double>"), lambda x: 1 + F.abs(x)).alias("depth"))
    words = vec.select(F.col("vec_id").alias("utt"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("w"))
    words = words.select("utt", "w", (F.col("w") * F.lit(0.015)).alias("start"), (F.lit(0.01) * (2 + (F.col("utt") + F.col("w")) % 4)).alias("dur"))
    return e.with_depth(words, depths).select("utt", "w", F.round("log_depth", 6).alias("log_depth"))


@query("""WITH m AS (SELECT p_brand AS word, array_to_string(list_transform(string_split(p_type || ' ' || substr(p_brand, 1, 5), ' '), lambda x: CASE WHEN x[1] IN ('S', 'P') THEN lower(x[1]) ELSE x END), ' ') AS pron, p_size FROM part)
SELECT word, pron, sum(p_size)::BIGINT AS count FROM m GROUP BY ALL""")
def mapped_soft_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("word"), F.split(F.concat_ws(" ", "p_type", F.substring("p_brand", 1, 5)), " ").alias("phones"), F.col("p_size").cast("bigint").alias("count"))
    names = rows.select(F.explode("phones").alias("phone")).distinct().where(F.substring("phone", 1, 1).isin("S", "P"))
    return e.soft_counts(rows, names.select("phone", F.lower(F.substring("phone", 1, 1)).alias("to")))


@query("""WITH l AS (SELECT p_brand AS word, count(DISTINCT p_type) AS own FROM part WHERE p_size > 25 GROUP BY p_brand), u AS (SELECT ceil(sum(own) / count(*)) AS usual FROM l)
SELECT word, 1.5::DOUBLE * coalesce(own, usual) AS quota FROM (SELECT DISTINCT p_brand AS word FROM part UNION SELECT DISTINCT p_type FROM part) LEFT JOIN l USING (word), u""")
def pronunciation_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = part.select(F.col("p_brand").alias("word")).unionByName(part.select(F.col("p_type").alias("word")))
    return e.variant_quota(words, part.where("p_size > 25").select(F.col("p_brand").alias("word"), F.col("p_type").alias("pron")), 1.5)


@query("""SELECT user_id AS recording, min(event_id) AS start, max(event_id + 1) AS "end", md5(string_agg(event_type, ' ' ORDER BY event_id)) AS digest, count(*)::INT AS utts FROM events GROUP BY user_id""")
def whole_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), F.col("event_id").alias("utt"), F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"), "event_type")
    return s.whole_recordings(rows, "event_type").select("recording", "start", "end", F.md5("text").alias("digest"), F.size("utts").alias("utts"))


@query()
def targets_on_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of two numbers of every fourth of a document's hundred characters, overlapping by some."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording"), F.col("n_chars").cast("int").alias("chars"))
    recordings = docs.select("recording", F.col("chars").alias("frames"))
    parts = docs.where("chars > 0").select("recording", F.explode(F.expr("sequence(0, chars - 1, 400)")).alias("at"))
    rows = parts.select("recording", F.concat_ws("-", "recording", "at").alias("utt"), (F.col("at") / 100).alias("start"), (F.col("at") / 100 + 4.2).alias("end"), F.array_repeat(F.array((F.col("at") % 1000 / 1000), F.lit(0.5)), 420).alias("targets"))
    done = s.targets_on_recordings(recordings, rows, [1.0, 0.0])
    total = F.aggregate("targets", F.lit(0.0), lambda a, x: a + x[0])
    return done.select("recording", F.size("targets").alias("frames"), F.round(total, 4).alias("total"))
