"""Vector transforms over `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import vectors as v
from ..session import table
from . import query
from .scoring import SQL_SCORES


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt"), F.col("label").alias("spk"), F.col("embedding").cast("array<double>").alias("vector"))


def digest(rows: DataFrame) -> DataFrame:
    """utt, and a few numbers of each vector."""
    return rows.select("utt", F.round(arrays.total(F.col("vector")), 5).alias("total"), F.round(F.element_at("vector", 1), 5).alias("first"), F.round(arrays.norm(F.col("vector")), 5).alias("norm"))


SQL_VEC = "WITH vec AS (SELECT vec_id AS utt, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
SQL_DIGEST = " SELECT utt, round(list_sum(v), 5) AS total, round(v[1], 5) AS first, round(sqrt(list_inner_product(v, v)), 5) AS norm FROM out"


@query(SQL_VEC + ", out AS (SELECT utt, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM vec)" + SQL_DIGEST)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(v.unit_length(labelled(spark, sf_dir)))


@query(SQL_VEC + """, d AS (SELECT utt, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec), c AS (SELECT utt, i, x - avg(x) OVER (PARTITION BY i) AS x FROM d),
l AS (SELECT utt, list(x ORDER BY i) AS v FROM c GROUP BY utt), out AS (SELECT utt, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM l)""" + SQL_DIGEST)
def centred_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return digest(v.chain(rows, "submean-norm", rows))


@query(SQL_VEC + ", out AS (SELECT a.utt, list_concat(a.v[3:10], b.v[1:4]) AS v FROM vec a JOIN vec b USING (utt) WHERE utt % 2 = 0)" + SQL_DIGEST)
def concatenated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    a = rows.withColumn("vector", v.dimensions(F.col("vector"), 2, 9))
    b = rows.where("utt % 2 = 0").withColumn("vector", v.dimensions(F.col("vector"), 0, 3))
    return digest(v.concatenated(a, b, "utt"))


@query(SQL_SCORES + "SELECT enroll, round(list_sum(v), 6) AS total, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM models")
def speaker_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.chain(labelled(spark, sf_dir), "mean", labelled(spark, sf_dir))
    return rows.select(F.col("spk").alias("enroll"), F.round(arrays.total(F.col("vector")), 6).alias("total"), F.round(arrays.norm(F.col("vector")), 6).alias("norm"))


@query()
def lda_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests hold the projection against numpy."""
    rows = labelled(spark, sf_dir)
    return digest(v.transformed(rows, v.lda(rows, "spk", 8)))


@query()
def zca_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return digest(v.transformed(rows, v.zca(rows)))


@query()
def pca_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return digest(v.transformed(rows, v.pca(rows, 16, whiten=True)))


def plda_trials(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    train, tests = rows.where("utt % 2 = 0"), rows.where("utt % 2 = 1")
    model = v.train_plda(train, "spk", rounds=5)
    if kind != "plda":
        mean, cov = v.in_domain(tests)
        into = v.train_plda(tests, "spk", rounds=3) if kind in ("lip", "cip") else None
        model = {"adapt": lambda: v.adapt(model, mean, cov), "coral": lambda: v.coral(model, mean, cov), "coral_plus": lambda: v.coral_plus(model, mean, cov), "lip": lambda: v.interpolate(model, into), "cip": lambda: v.coral_interpolate(model, into, cov), "quadratic": lambda: model}[kind]()
    means = v.mean_vectors(train, ["spk"], "vector").select(F.col("spk").alias("enroll"), F.col("mean").alias("vector"), "n")
    pairs = means.select("enroll").crossJoin(tests.select(F.col("utt").alias("test"), "spk")).select("enroll", "test", (F.col("spk") == F.col("enroll")).alias("target"))
    tests = tests.select(F.col("utt").alias("test"), "vector")
    scored = v.quadratic_scores(pairs, means, tests, model) if kind == "quadratic" else v.plda_scores(pairs, means, tests, model)
    return scored.select("enroll", "test", "target", F.round("score", 4).alias("score"))


def register() -> None:
    """A query for PLDA and each of its adaptations; tests hold the formulas against numpy."""
    for kind in ("plda", "quadratic", "adapt", "coral", "coral_plus", "lip", "cip"):

        def build(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
            return plda_trials(spark, sf_dir, kind)

        build.__name__ = f"plda_scores_{kind}" if kind != "plda" else "plda_scores"
        query()(build)


register()
