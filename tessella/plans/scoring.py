"""Trials over `embeddings` (an utterance is a vector, its speaker the label), and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, blocks, metrics, trials
from ..session import pinned, table
from . import query

DIM = 64

#: Shared SQL: unit vectors, speaker means, and the cosine of every trial.
SQL_SCORES = """
WITH vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
dims AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY label, i),
models AS (SELECT label AS enroll, list(m ORDER BY i) AS v FROM dims GROUP BY label),
scores AS (
  SELECT enroll, vec_id AS test, enroll = label AS target, round(list_cosine_similarity(m.v, e.v), 6) AS score
  FROM models m CROSS JOIN vec e)
"""


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """enroll, test, target, score: every speaker's mean against every vector."""
    vec = embedded(spark, sf_dir)
    models = aggregates.mean_vectors(vec, ["label"], "v").select(F.col("label").alias("enroll"), F.col("mean").alias("vector"))
    pairs = trials.generate(models.select("enroll"), vec.select(F.col("vec_id").alias("test"), F.col("label").alias("spk")))
    scored = trials.cosine_scores(pairs, models, vec.select(F.col("vec_id").alias("test"), F.col("v").alias("vector")))
    return scored.withColumn("score", F.round("score", 6))


def cohort(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scores of all trials, those of speakers against the cohort (every seventh vector), the vectors as tests, and those of the cohort."""
    vec = embedded(spark, sf_dir)
    all_scores = scores(spark, sf_dir)
    enroll = all_scores.where("test % 7 = 0").select("enroll", F.col("test").alias("cohort"), "score")
    return all_scores, enroll, vec.select(F.col("vec_id").alias("test"), F.col("v").alias("vector")), vec.where("vec_id % 7 = 0").select(F.col("vec_id").alias("cohort"), F.col("v").alias("vector"))


SQL_COHORT = SQL_SCORES + """,
trial AS (SELECT * FROM scores),
ec AS (SELECT enroll, test AS cohort, score FROM scores WHERE test % 7 = 0),
tc AS (
  SELECT t.vec_id AS test, c.vec_id AS cohort, round(list_cosine_similarity(c.v, t.v), 6) AS score
  FROM vec t CROSS JOIN vec c WHERE c.vec_id % 7 = 0)
"""

SQL_SWEEP = SQL_SCORES + """,
swept AS (
  SELECT score, target, sum(target::INT) OVER w AS fr, sum((NOT target)::INT) OVER w AS n_upto,
         row_number() OVER w AS rn, sum(target::INT) OVER () AS p, sum((NOT target)::INT) OVER () AS n
  FROM scores WINDOW w AS (ORDER BY score, target, enroll, test ROWS UNBOUNDED PRECEDING)),
rates AS (SELECT *, (n - n_upto) / n AS far, fr / p AS frr FROM swept)
"""


@query(SQL_SWEEP + """,
stepped AS (SELECT *, lag(far) OVER (ORDER BY rn) AS far0, lag(frr) OVER (ORDER BY rn) AS frr0 FROM rates),
hit AS (SELECT * FROM stepped WHERE far <= frr ORDER BY rn LIMIT 1)
SELECT round(CASE WHEN far0 IS NULL OR abs(far - frr) <= abs(far0 - frr0) THEN (far + frr) / 2 ELSE (far0 + frr0) / 2 END, 6) AS eer,
       score AS threshold,
       (SELECT round(min(0.01 * frr + 0.99 * far) / 0.01, 6) FROM rates) AS min_dcf
FROM hit""")
def trials_eer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker means against all vectors: cosine, equal error rate, minimum detection cost."""
    rows = scores(spark, sf_dir)
    points = pinned(metrics.sweep(rows))
    return metrics.eer(rows, points=points).select(F.round("eer", 6).alias("eer"), "threshold").join(F.broadcast(metrics.min_dcf(rows, points=points).select(F.round("min_dcf", 6).alias("min_dcf"))))


@query(SQL_SCORES + "SELECT enroll, test, target, score FROM scores")
def trial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("enroll", "test", "target", "score")


@query("SELECT l.label AS enroll, e.vec_id AS test, e.label = l.label AS target FROM embeddings e CROSS JOIN (SELECT DISTINCT label FROM embeddings) l WHERE e.vec_id % 11 <> 0")
def trials_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings")
    bad = vec.where("vec_id % 11 = 0").select(F.col("vec_id").alias("test"))
    return trials.generate(vec.select(F.col("label").alias("enroll")), vec.select(F.col("vec_id").alias("test"), F.col("label").alias("spk")), bad)


@query(SQL_SCORES + """
SELECT score, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 8) AS far, round(coalesce(sum(p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(p) OVER (), 8) AS frr
FROM (SELECT score, sum(target::INT) AS p, sum((NOT target)::INT) AS n FROM scores GROUP BY score)""")
def det_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.det_points(scores(spark, sf_dir)).select("score", F.round("far", 8).alias("far"), F.round("frr", 8).alias("frr"))


@query(SQL_SCORES + """
SELECT round(max(frr), 8) AS frr FROM (
  SELECT sum(n) OVER (ORDER BY score DESC) / sum(n) OVER () AS far, coalesce(sum(p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(p) OVER () AS frr
  FROM (SELECT score, sum(target::INT) AS p, sum((NOT target)::INT) AS n FROM scores GROUP BY score))
WHERE far >= 0.0005""")
def frr_at_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.frr_at_far(scores(spark, sf_dir)).select(F.round("frr", 8).alias("frr"))


def cavg_sql(where: str, open_set: bool) -> str:
    weight = "0.5 / n_langs" if open_set else "0.5 / (n_langs - 1)"
    utt_lang = "CASE WHEN label IN (SELECT enroll FROM scored) THEN label::VARCHAR ELSE '' END" if open_set else "label::VARCHAR"
    return SQL_SCORES + f""",
scored AS (SELECT enroll, test, score FROM scores WHERE {where}),
k AS (SELECT enroll::VARCHAR AS lang, {utt_lang} AS utt_lang, score FROM scored JOIN embeddings ON vec_id = test {'' if open_set else 'WHERE label IN (SELECT enroll FROM scored)'}),
lim AS (SELECT min(score) AS lo, max(score) AS hi, count(DISTINCT lang) AS n_langs FROM k),
t AS (SELECT n_langs, lo + (hi - lo) * s / 20 AS t, s FROM lim, range(21) r(s)),
r AS (SELECT s, n_langs, lang, utt_lang, avg((score < t)::INT) AS below FROM k, t GROUP BY ALL)
SELECT round(min(cost), 6) AS cavg FROM (
  SELECT s, sum(CASE WHEN lang = utt_lang THEN 0.5 * below ELSE {weight} * (1 - below) END) / any_value(n_langs) AS cost FROM r GROUP BY s)"""


@query(cavg_sql("true", False))
def cavg_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    langs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt"), F.col("label").alias("utt_lang"))
    return metrics.cavg(rows.select(F.col("enroll").alias("lang"), F.col("test").alias("utt"), "score"), langs).select(F.round("cavg", 6).alias("cavg"))


@query(cavg_sql("enroll < 6", True))
def cavg_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).where("enroll < 6")
    langs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt"), F.col("label").alias("utt_lang"))
    return metrics.cavg(rows.select(F.col("enroll").alias("lang"), F.col("test").alias("utt"), "score"), langs, open_set=True).select(F.round("cavg", 6).alias("cavg"))


@query(SQL_SCORES + """,
asv AS (SELECT CASE WHEN test % 3 = 0 THEN 'spoof' WHEN target THEN 'target' ELSE 'nontarget' END AS kind, score FROM scores),
s AS (
  SELECT score, kind = 'target' AS y, sum((kind = 'target')::INT) OVER w AS fr, sum((kind <> 'target')::INT) OVER w AS nu, row_number() OVER w AS rn,
         sum((kind = 'target')::INT) OVER () AS p, sum((kind <> 'target')::INT) OVER () AS n
  FROM asv WHERE kind <> 'spoof' WINDOW w AS (ORDER BY score, kind = 'target' ROWS UNBOUNDED PRECEDING)),
thr AS (SELECT arg_min(score, rn) AS t FROM s WHERE (n - nu) / n <= fr / p),
rate AS (
  SELECT avg((score < t)::INT) FILTER (kind = 'target') AS miss, avg((score >= t)::INT) FILTER (kind = 'nontarget') AS fa,
         avg((score < t)::INT) FILTER (kind = 'spoof') AS miss_spoof FROM asv, thr),
beta AS (SELECT (0.9405::DOUBLE * (1 - miss) - 0.0095::DOUBLE * 10 * fa) / (10 * 0.05::DOUBLE * (1 - miss_spoof)) AS beta FROM rate),
cm AS (SELECT score, (target)::INT AS p, (NOT target)::INT AS n FROM scores WHERE test % 2 = 0),
g AS (SELECT score, sum(p) AS p, sum(n) AS n FROM cm GROUP BY score),
curve AS (
  SELECT sum(n) OVER (ORDER BY score DESC) / sum(n) OVER () AS far, coalesce(sum(p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(p) OVER () AS frr FROM g
  UNION ALL SELECT 0.0, 1.0)
SELECT round(min(beta * frr + far), 6) AS min_tdcf FROM curve, beta""")
def tandem_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    kind = F.when(F.col("test") % 3 == 0, "spoof").when(F.col("target"), "target").otherwise("nontarget")
    return metrics.min_tdcf(rows.select(kind.alias("kind"), "score"), rows.where("test % 2 = 0").select("target", "score")).select(F.round("min_tdcf", 6).alias("min_tdcf"))


SQL_RANKED = SQL_SCORES + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY enroll ORDER BY score DESC, test) AS rank FROM scores)"


@query(SQL_RANKED + ", p AS (SELECT enroll, rank, sum(target::INT) OVER (PARTITION BY enroll ORDER BY rank) / rank AS p FROM ranked WHERE rank <= 10) SELECT round(avg(ap), 8) AS map FROM (SELECT sum(p) / 10 AS ap FROM p GROUP BY enroll)")
def map_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import top_n

    ranking = top_n(scores(spark, sf_dir), ["enroll"], "score", "test", 10)
    return metrics.mean_precision(ranking, "enroll", "rank", F.col("target")).select(F.round("map", 8).alias("map"))


@query(SQL_RANKED + "SELECT enroll, string_agg(test, ' ' ORDER BY rank) AS tests FROM ranked WHERE rank <= 10 GROUP BY enroll")
def retrieval_top_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import top_lists

    lists = top_lists(scores(spark, sf_dir), "enroll", "score", "test", 10)
    return lists.select("enroll", F.array_join(F.col("items").cast("array<string>"), " ").alias("tests"))


SQL_NORMED = """
SELECT enroll, test, target, round(0.5 * ((score - me) / se + (score - mt) / st), 5) AS score
FROM trial JOIN e USING (enroll) JOIN t USING (test)"""


@query(SQL_COHORT + ", e AS (SELECT enroll, avg(score) AS me, stddev_samp(score) AS se FROM ec GROUP BY enroll), t AS (SELECT test, avg(score) AS mt, stddev_samp(score) AS st FROM tc GROUP BY test)" + SQL_NORMED)
def score_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, enroll, tests, others = cohort(spark, sf_dir)
    return trials.s_norm_by(rows, trials.cohort_stats(enroll, "enroll"), blocks.cohort_moments(tests, others), "left").select("enroll", "test", "target", F.round("score", 5).alias("score"))


@query()
def score_norm_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_norm under its earlier name."""
    return score_norm(spark, sf_dir)


@query(SQL_COHORT + """,
er AS (SELECT * FROM ec QUALIFY row_number() OVER (PARTITION BY enroll ORDER BY score DESC, cohort) <= 20),
tr AS (SELECT * FROM tc QUALIFY row_number() OVER (PARTITION BY test ORDER BY score DESC, cohort) <= 20),
e AS (SELECT enroll, avg(score) AS me, stddev_samp(score) AS se FROM er GROUP BY enroll), t AS (SELECT test, avg(score) AS mt, stddev_samp(score) AS st FROM tr GROUP BY test)""" + SQL_NORMED)
def adaptive_score_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, enroll, tests, others = cohort(spark, sf_dir)
    best = blocks.cohort_best(tests, others, 20)
    return trials.s_norm_by(rows, trials.cohort_stats(enroll, "enroll", 20), trials.cohort_stats(best, "test", 20), "left").select("enroll", "test", "target", F.round("score", 5).alias("score"))


@query()
def adaptive_score_norm_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adaptive_score_norm under its earlier name."""
    return adaptive_score_norm(spark, sf_dir)


@query(SQL_COHORT + """,
er AS (SELECT * FROM ec QUALIFY row_number() OVER (PARTITION BY enroll ORDER BY score DESC, cohort) <= 20),
tr AS (SELECT * FROM tc QUALIFY row_number() OVER (PARTITION BY test ORDER BY score DESC, cohort) <= 20),
t AS (SELECT p.enroll, p.test, avg(c.score) AS mt, stddev_samp(c.score) AS st FROM trial p JOIN er USING (enroll) JOIN tc c ON c.test = p.test AND c.cohort = er.cohort GROUP BY ALL),
e AS (SELECT p.enroll, p.test, avg(c.score) AS me, stddev_samp(c.score) AS se FROM trial p JOIN tr USING (test) JOIN ec c ON c.enroll = p.enroll AND c.cohort = tr.cohort GROUP BY ALL)
SELECT enroll, test, target, round(0.5 * ((score - me) / se + (score - mt) / st), 5) AS score
FROM trial JOIN e USING (enroll, test) JOIN t USING (enroll, test)""")
def cross_score_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.s_norm_cross_vectors(*cohort(spark, sf_dir), top=20).select("enroll", "test", "target", F.round("score", 5).alias("score"))


@query()
def cross_score_norm_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cross_score_norm under its earlier name."""
    return cross_score_norm(spark, sf_dir)


@query(SQL_SCORES + "SELECT enroll, test, round(0.3::DOUBLE * a + 0.7::DOUBLE * score, 8) AS score FROM (SELECT s.enroll, s.test, s.score, coalesce(round(o.score * o.score, 6), 0) AS a FROM scores s LEFT JOIN (SELECT * FROM scores WHERE test % 3 = 0) o USING (enroll, test))")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    first = rows.where("test % 3 = 0").withColumn("score", F.round(F.col("score") * F.col("score"), 6))
    return trials.weighted_scores(first, rows, ["enroll", "test"], 0.3, 0.7).withColumn("score", F.round("score", 8))


@query(SQL_SCORES + """,
sys AS (SELECT enroll, test, target, score AS a, round(score * score + (test % 5) * 0.01::DOUBLE, 6) AS b FROM scores),
g AS (SELECT target, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a*a) AS saa, sum(a*b) AS sab, sum(b*b) AS sbb FROM sys GROUP BY target),
w AS (SELECT sum(saa - sa*sa/n)/sum(n) AS aa, sum(sab - sa*sb/n)/sum(n) AS ab, sum(sbb - sb*sb/n)/sum(n) AS bb,
             sum(saa)/sum(n) - (sum(sa)/sum(n))**2 AS ta, sum(sab)/sum(n) - sum(sa)*sum(sb)/sum(n)**2 AS tab, sum(sbb)/sum(n) - (sum(sb)/sum(n))**2 AS tb,
             sum(CASE WHEN target THEN sa/n ELSE -sa/n END) AS da, sum(CASE WHEN target THEN sb/n ELSE -sb/n END) AS db FROM g),
m AS (SELECT 0.9::DOUBLE*aa + 0.1::DOUBLE*ta + 1e-12 AS x, 0.9::DOUBLE*ab + 0.1::DOUBLE*tab AS y, 0.9::DOUBLE*bb + 0.1::DOUBLE*tb + 1e-12 AS z, da, db FROM w),
s AS (SELECT (z*da - y*db)/(x*z - y*y) AS w1, (x*db - y*da)/(x*z - y*y) AS w2 FROM m)
SELECT enroll, test, target, round((a*w1 + b*w2) / sqrt(w1*w1 + w2*w2), 5) AS score FROM sys, s""")
def lda_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    systems = {"a": rows, "b": rows.withColumn("score", F.round(F.col("score") * F.col("score") + (F.col("test") % 5) * 0.01, 6))}
    vectors = trials.system_vectors(systems, rows.select("enroll", "test", "target"))
    weights = dict(zip(systems, trials.lda_weights(vectors, list(systems))))
    return trials.fused(vectors, weights).withColumn("score", F.round("score", 5))


@query(SQL_SCORES + """,
best AS (SELECT test, arg_max(enroll, struct_pack(s := score, e := -enroll)) AS guess FROM scores GROUP BY test)
SELECT round(avg((guess = label)::INT), 8) AS accuracy FROM best JOIN embeddings ON vec_id = test""")
def identification_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scores(spark, sf_dir).groupBy("test").agg(F.max_by("enroll", F.struct("score", -F.col("enroll"))).alias("guess"))
    joined = best.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("test"), "label"), "test")
    return metrics.accuracy(joined, "guess", "label").select(F.round("accuracy", 8).alias("accuracy"))
