"""Gaussian mixtures with diagonal covariance for each class, trained by expectation and maximisation over Spark, and their scores.

A round is one pass: each task turns its vectors into sums by class and component, and Spark adds these up. The driver
holds the models: classes x components x dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..session import pinned


@dataclass(frozen=True)
class Mixture:
    """weights (k), means and variances (k x d)."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each row under each component."""
        flat = np.log(self.weights) - 0.5 * np.log(2 * np.pi * self.variances).sum(axis=1)
        inverse = 1 / self.variances
        return flat - 0.5 * ((x * x) @ inverse.T - 2 * x @ (self.means * inverse).T + (self.means**2 * inverse).sum(axis=1))

    def loglike(self, x: np.ndarray) -> np.ndarray:
        joint = self.joint(x)
        top = joint.max(axis=1)
        return top + np.log(np.exp(joint - top[:, None]).sum(axis=1))


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def fitted(rows: DataFrame, label: str, key: str, vector: str, k: int, rounds: int = 20, least_weight: float = 1e-4, floor: float = 1e-3, seed: int = 1) -> tuple[dict, list[float]]:
    """({class: Mixture}, the log-likelihood of all rows before each round) of vectors by class.

    A class starts from k of its vectors, those with the smallest hashes of their keys (fewer, if it has fewer), with the
    variances of the class; variances stay above `floor` times those, and components below least_weight go. Rows with a null class or vector are left out.
    """
    data = pinned(rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(key).alias("key"), arrays.doubles(F.col(vector)).alias("x")))
    chosen = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "key"), "key")
    starts: dict = {}
    for r in data.withColumn("__r", F.row_number().over(chosen)).where(F.col("__r") <= k).orderBy("label", "__r").collect():
        starts.setdefault(r["label"], []).append(r["x"])
    whole = moments(data, {c: None for c in starts})
    models, floors = {}, {}
    for c, points in starts.items():
        n, s, q, _ = whole[c]
        spread = np.maximum(q[0] / n[0] - (s[0] / n[0]) ** 2, 1e-12)
        floors[c] = floor * spread
        models[c] = Mixture(np.full(len(points), 1 / len(points)), np.array(points), np.tile(spread, (len(points), 1)))
    likes = []
    for _ in range(rounds if models else 0):
        sums = moments(data, models)
        likes.append(sum(like for *_, like in sums.values()))
        for c, (n, s, q, _) in sums.items():
            stay = n >= max(least_weight * n.sum(), 1e-10)
            n, s, q = n[stay], s[stay], q[stay]
            means = s / n[:, None]
            models[c] = Mixture(n / n.sum(), means, np.maximum(q / n[:, None] - means**2, floors[c]))
    return models, likes


def moments(data: DataFrame, models: dict) -> dict:
    """class -> (n, sums, sums of squares by component, log-likelihood) of vectors shared out by their models; one component takes all where there is no model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for frame in frames:
            for c, own in frame.groupby("label", sort=False):
                x, model = stacked(own["x"]), models.get(c)
                joint = model.joint(x) if model else np.zeros((len(x), 1))
                top = joint.max(axis=1, keepdims=True)
                share = np.exp(joint - top)
                total = share.sum(axis=1, keepdims=True)
                share /= total
                new = np.concatenate([share.sum(axis=0)[:, None], share.T @ x, share.T @ (x * x)], axis=1), float((top + np.log(total)).sum())
                old = sums.get(c)
                sums[c] = new if old is None else (old[0] + new[0], old[1] + new[1])
        for c, (table, like) in sums.items():
            yield pd.DataFrame({"label": c, "at": np.arange(table.size + 1), "v": np.append(table.ravel(), like)})

    kind = data.schema["label"].dataType.simpleString()
    added = data.select("label", "x").mapInPandas(run, f"label {kind}, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    flat: dict = {}
    for r in sorted(added, key=lambda r: r["at"]):
        flat.setdefault(r["label"], []).append(r["v"])
    out = {}
    for c, v in flat.items():
        k = len(models[c].weights) if models[c] else 1
        table = np.array(v[:-1]).reshape(k, -1)
        d = (table.shape[1] - 1) // 2
        out[c] = table[:, 0], table[:, 1 : 1 + d], table[:, 1 + d :], v[-1]
    return out


def scores(trials: DataFrame, tests: DataFrame, models: dict, background: Mixture | None = None) -> DataFrame:
    """trials (enroll: a class, test) with score, the log-likelihood of the test vector (test, vector) under the class, less that under a background model if there is one.

    Trials without a vector go; a class without a model has a null score.
    """
    joined = trials.select("enroll", "test").join(tests.select("test", arrays.doubles(F.col("vector")).alias("x")).where("x IS NOT NULL"), "test")
    kinds = {c: joined.schema[c].dataType.simpleString() for c in ("enroll", "test")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = pd.Series(np.nan, frame.index)
            for c, own in frame.groupby("enroll", sort=False):
                if c in models:
                    x = stacked(own["x"])
                    score[own.index] = models[c].loglike(x) - (background.loglike(x) if background else 0)
            yield pd.DataFrame({"enroll": frame["enroll"], "test": frame["test"], "score": score})

    made = joined.mapInPandas(run, f"enroll {kinds['enroll']}, test {kinds['test']}, score double")
    return made.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
