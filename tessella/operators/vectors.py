"""Embedding transforms: centring, length norm, LDA, whitening, PLDA and its adaptations.

Statistics are summed in Spark; the driver works on matrices of the vectors' dimension; matrices go back
to the executors inside the function that applies them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from .aggregates import mean_vectors, scatter

VECTOR = "vector"


def global_mean(rows: DataFrame, vector: str = VECTOR) -> list[float]:
    """The mean of all vectors."""
    return list(mean_vectors(rows, [], vector).first()["mean"])


def centred(rows: DataFrame, mean: list[float], vector: str = VECTOR) -> DataFrame:
    """Vectors less a mean (V2)."""
    return rows.withColumn(vector, arrays.minus(arrays.doubles(F.col(vector)), F.array(*[F.lit(float(x)) for x in mean])))


def unit_length(rows: DataFrame, vector: str = VECTOR) -> DataFrame:
    """Vectors of length 1 (V3)."""
    return rows.withColumn(vector, arrays.unit(arrays.doubles(F.col(vector))))


def transformed(rows: DataFrame, matrix: np.ndarray, vector: str = VECTOR) -> DataFrame:
    """matrix @ vector; with one more column the matrix is affine (V4)."""
    m = np.asarray(matrix, float)

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, m.shape[1]))
        y = x @ m[:, : x.shape[1]].T
        return pd.Series(list(y + m[:, -1] if m.shape[1] > x.shape[1] else y))

    return rows.withColumn(vector, apply(arrays.doubles(F.col(vector))))


def concatenated(left: DataFrame, right: DataFrame, key: str, vector: str = VECTOR) -> DataFrame:
    """Vectors of two tables one after the other, for the keys of both."""
    return left.join(right.select(key, F.col(vector).alias("__other")), key).withColumn(vector, F.concat(vector, "__other")).drop("__other")


def dimensions(v: Column, first: int, last: int) -> Column:
    """Dimensions first to last, from 0."""
    return F.slice(v, first + 1, last - first + 1)


@dataclass
class Scatter:
    """Means of the classes with their sizes, the whole mean, and covariances within and between classes."""

    means: np.ndarray
    sizes: np.ndarray
    mean: np.ndarray
    within: np.ndarray
    between: np.ndarray


def class_scatter(rows: DataFrame, label: str, vector: str = VECTOR) -> Scatter:
    """Scatter statistics of labelled vectors."""
    second, first, n, groups = scatter(rows, vector, label)
    means, sizes = np.stack(groups["mean"].to_numpy()), groups["n"].to_numpy(float)
    mean = first / n
    between_raw = (means * sizes[:, None]).T @ means
    return Scatter(means, sizes, mean, (second - between_raw) / n, between_raw / n - np.outer(mean, mean))


def lda(rows: DataFrame, label: str, dim: int, total_factor: float = 0.1, vector: str = VECTOR) -> np.ndarray:
    """An affine LDA of `dim` rows that whitens (1 - f) * within + f * total covariance (V5)."""
    s = class_scatter(rows, label, vector)
    mixed = (1 - total_factor) * s.within + total_factor * (s.within + s.between)
    white = inverse_root(mixed)
    values, vectors = np.linalg.eigh(white @ s.between @ white.T)
    m = oriented(vectors[:, np.argsort(-values)[:dim]].T) @ white
    return np.hstack([m, (-m @ s.mean)[:, None]])


def oriented(rows: np.ndarray) -> np.ndarray:
    """Rows with the sign that makes their largest entry positive, so that results do not depend on the solver."""
    at = np.abs(rows).argmax(axis=1)
    return rows * np.sign(rows[np.arange(len(rows)), at])[:, None]


def inverse_root(cov: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """The symmetric inverse square root of a covariance."""
    values, vectors = np.linalg.eigh(cov)
    return (vectors / np.sqrt(np.maximum(values, floor))) @ vectors.T


def zca(rows: DataFrame, vector: str = VECTOR, centre: bool = False, floor: float = 1e-6) -> np.ndarray:
    """ZCA whitening from X'X / (n - 1), uncentred unless asked for (V6)."""
    second, first, n, _ = scatter(rows, vector)
    cov = (second - (np.outer(first, first) / n if centre else 0)) / (n - 1)
    return inverse_root(cov, floor)


def pca(rows: DataFrame, dim: int, whiten: bool = False, vector: str = VECTOR) -> np.ndarray:
    """An affine PCA of `dim` rows, to unit variances if asked for (V7)."""
    second, first, n, _ = scatter(rows, vector)
    mean = first / n
    values, vectors = np.linalg.eigh(second / n - np.outer(mean, mean))
    order = np.argsort(-values)[:dim]
    m = oriented(vectors[:, order].T)
    if whiten:
        m = m / np.sqrt(np.maximum(values[order], 1e-10))[:, None]
    return np.hstack([m, (-m @ mean)[:, None]])


# PLDA


@dataclass
class Plda:
    """Two-covariance PLDA: mean and covariances within and between classes."""

    mean: np.ndarray
    within: np.ndarray
    between: np.ndarray

    def diagonal(self) -> tuple[np.ndarray, np.ndarray]:
        """A transform that makes `within` the identity and `between` diagonal, and that diagonal, descending."""
        low = np.linalg.inv(np.linalg.cholesky(self.within))
        values, vectors = np.linalg.eigh(low @ self.between @ low.T)
        order = np.argsort(-values)
        return oriented(vectors[:, order].T) @ low, np.maximum(values[order], 0)


def train_plda(rows: DataFrame, label: str, rounds: int = 10, vector: str = VECTOR) -> Plda:
    """EM for the covariances from class means and the offset scatter (V8)."""
    s = class_scatter(rows, label, vector)
    dim = len(s.mean)
    n, total = s.sizes, s.sizes.sum()
    offsets = s.within * total
    within, between = np.eye(dim), np.eye(dim)
    means = s.means - s.mean
    for _ in range(rounds):
        w_stats, w_count = offsets.copy(), total - len(n)
        b_stats = np.zeros((dim, dim))
        w_inv, b_inv = np.linalg.inv(within), np.linalg.inv(between)
        for size in np.unique(n):
            at = means[n == size]
            mix = np.linalg.inv(b_inv + size * w_inv)
            w = at @ (size * w_inv) @ mix.T
            rest = at - w
            w_stats += size * (len(at) * mix + rest.T @ rest)
            b_stats += len(at) * mix + w.T @ w
            w_count += len(at)
        within, between = w_stats / w_count, b_stats / len(n)
    return Plda(s.mean, within, between)


def plda_scores(trials: DataFrame, models: DataFrame, tests: DataFrame, plda: Plda, normalise: bool = True) -> DataFrame:
    """Log-likelihood ratios of trials (M16). models: enroll, vector, n (enrolled utterances); tests: test, vector."""
    transform, psi = plda.diagonal()
    affine = np.hstack([transform, (-transform @ plda.mean)[:, None]])
    psi_col = F.array(*[F.lit(float(x)) for x in psi])
    dim = len(psi)

    def projected(rows: DataFrame, n: Column) -> DataFrame:
        out = transformed(rows, affine)
        if normalise:
            inner = arrays.total(F.zip_with(VECTOR, psi_col, lambda x, p: x * x / (p + F.lit(1.0) / n)))
            out = out.withColumn(VECTOR, arrays.scaled(F.col(VECTOR), F.sqrt(F.lit(float(dim)) / inner)))
        return out

    a = projected(models, F.col("n")).select("enroll", "n", F.col(VECTOR).alias("__a"))
    b = projected(tests, F.lit(1.0)).select("test", F.col(VECTOR).alias("__b"))
    joined = trials.join(a, "enroll").join(b, "test")
    given = F.transform(F.arrays_zip(F.col("__a"), F.col("__b"), psi_col.alias("__p")), lambda z: llr_term(z["__a"], z["__b"], z["__p"], F.col("n")))
    return joined.withColumn("score", arrays.total(given)).drop("__a", "__b", "n")


def llr_term(a: Column, b: Column, psi: Column, n: Column) -> Column:
    """One dimension of log P(b | same) - log P(b | other), with within-variance 1."""
    mean = n * psi / (n * psi + 1) * a
    var = F.lit(1.0) + psi / (n * psi + 1)
    other = F.lit(1.0) + psi
    return -0.5 * (F.ln(var) + (b - mean) * (b - mean) / var) + 0.5 * (F.ln(other) + b * b / other)


def length_factor(v: Column, psi: list[float], n: Column) -> Column:
    """sqrt(dim / sum x^2 / (psi + 1 / n))."""
    inner = arrays.total(F.zip_with(v, F.array(*[F.lit(float(x)) for x in psi]), lambda x, p: x * x / (p + F.lit(1.0) / n)))
    return F.sqrt(F.lit(float(len(psi))) / inner)


# Adaptation: each takes the out-of-domain model and in-domain vectors without labels


def in_domain(rows: DataFrame, vector: str = VECTOR) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of unlabelled vectors."""
    second, first, n, _ = scatter(rows, vector)
    mean = first / n
    return mean, second / n - np.outer(mean, mean)


def adapt(plda: Plda, mean: np.ndarray, cov: np.ndarray, within_scale: float = 0.3, between_scale: float = 0.7) -> Plda:
    """Excess variance over the model's own is shared out between the covariances (V9)."""
    total = plda.within + plda.between
    low = np.linalg.inv(np.linalg.cholesky(total))
    values, vectors = np.linalg.eigh(low @ cov @ low.T)
    back = np.linalg.cholesky(total) @ vectors
    excess = (back * np.maximum(values - 1, 0)) @ back.T
    return Plda(mean, plda.within + within_scale * excess, plda.between + between_scale * excess)


def root(cov: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(cov)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def coral(plda: Plda, mean: np.ndarray, cov: np.ndarray) -> Plda:
    """Whiten by the model's total covariance, recolour by the in-domain one."""
    a = root(cov) @ inverse_root(plda.within + plda.between, 1e-12)
    return Plda(mean, a @ plda.within @ a.T, a @ plda.between @ a.T)


def positive_part(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """What `new` has more than `old`, in the directions where it has more."""
    low = np.linalg.inv(np.linalg.cholesky(old))
    values, vectors = np.linalg.eigh(low @ new @ low.T)
    back = np.linalg.cholesky(old) @ vectors
    return (back * np.maximum(values - 1, 0)) @ back.T


def coral_plus(plda: Plda, mean: np.ndarray, cov: np.ndarray, within: float = 0.8, between: float = 0.8) -> Plda:
    """CORAL, of which only the directions that grow are added."""
    to = coral(plda, mean, cov)
    return Plda(mean, plda.within + within * positive_part(to.within, plda.within), plda.between + between * positive_part(to.between, plda.between))


def interpolate(out: Plda, into: Plda, share: float = 0.4, regular: bool = False) -> Plda:
    """Linear interpolation of covariances towards a second model (V12); regular: only growing directions."""
    mix = (lambda a, b: a + share * positive_part(b, a)) if regular else (lambda a, b: (1 - share) * a + share * b)
    return Plda(into.mean, mix(out.within, into.within), mix(out.between, into.between))


def coral_interpolate(out: Plda, into: Plda, cov: np.ndarray, share: float = 0.5, regular: bool = False) -> Plda:
    """Interpolation of the CORAL result with a model of the domain."""
    return interpolate(coral(out, into.mean, cov), into, share, regular)


def quadratic_scores(trials: DataFrame, models: DataFrame, tests: DataFrame, plda: Plda) -> DataFrame:
    """Gaussian PLDA as a quadratic form: x' L y + (x' G x + y' G y) + (x + y)' c, constant left out."""
    total = plda.within + plda.between
    t_inv = np.linalg.inv(total)
    inner = np.linalg.inv(total - plda.between @ t_inv @ plda.between)
    gamma = 0.5 * (t_inv - inner)
    lam = t_inv @ plda.between @ inner
    lam, gamma = (lam + lam.T) / 2, (gamma + gamma.T) / 2
    c = -(lam + 2 * gamma) @ plda.mean

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = np.stack(a.to_numpy()), np.stack(b.to_numpy())
        return pd.Series(((x @ lam) * y).sum(1) + ((x @ gamma) * x).sum(1) + ((y @ gamma) * y).sum(1) + (x + y) @ c)

    joined = trials.join(models.select("enroll", F.col(VECTOR).alias("__a")), "enroll").join(tests.select("test", F.col(VECTOR).alias("__b")), "test")
    return joined.withColumn("score", score(arrays.doubles(F.col("__a")), arrays.doubles(F.col("__b")))).drop("__a", "__b")


# Chains of named steps

Step = Callable[[DataFrame, DataFrame], DataFrame]
#: name -> function of (rows, the rows that train it); rows: utt, spk, vector.
STEPS: dict[str, Step] = {
    "norm": lambda rows, _: unit_length(rows),
    "submean": lambda rows, train: centred(rows, global_mean(train)),
    "whiten": lambda rows, train: transformed(rows, zca(train)),
    "pcawhiten": lambda rows, train: transformed(rows, pca(train, len(train.first()[VECTOR]), whiten=True)),
    "mean": lambda rows, _: mean_vectors(rows, ["spk"], VECTOR).select(F.col("spk").alias("utt"), "spk", F.col("mean").alias(VECTOR), "n"),
}


def register_step(name: str, step: Step) -> None:
    """Add a step that chains may name."""
    STEPS[name] = step


def chain(rows: DataFrame, steps: str, train: DataFrame) -> DataFrame:
    """Steps joined by '-', e.g. 'submean-norm'. Each is trained on `train` as the steps before have made it."""
    for name in filter(None, steps.split("-")):
        if name.startswith("lda"):
            matrix = lda(train, "spk", int(name[3:] or 10))
            rows, train = transformed(rows, matrix), transformed(train, matrix)
            continue
        if name not in STEPS:
            raise ValueError(f"unknown step {name}; there are lda<dim>, {', '.join(sorted(STEPS))}")
        step = STEPS[name]
        rows, train = step(rows, train), (train if name == "mean" else step(train, train))
    return rows
