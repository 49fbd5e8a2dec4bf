"""Mixtures by class against a plain loop over numpy arrays."""

import numpy as np
import pytest

from tessella.operators import mixtures


def data():
    rng = np.random.default_rng(4)
    out = []
    for c, centres in (("a", [(-4, 0), (4, 1)]), ("b", [(0, 6), (1, -6), (9, 9)])):
        for j, centre in enumerate(centres):
            out += [(c, f"{c}{j}{i:03d}", (rng.normal(size=2) * (1 + j) + centre).tolist()) for i in range(150)]
    return out


def test_mixtures_against_numpy(spark):
    rows = data()
    df = spark.createDataFrame([*rows, ("c", "one", [1.0, 2.0]), (None, "x", [0.0, 0.0]), ("a", "none", None)], "c string, k string, v array<double>").repartition(5)
    models, likes = mixtures.fitted(df, "c", "k", "v", 3, rounds=8)
    assert all(b >= a - 1e-6 for a, b in zip(likes, likes[1:])) and likes[-1] > likes[0] + 100
    start, _ = mixtures.fitted(df, "c", "k", "v", 3, rounds=0)
    for c in "ab":
        x = np.array([v for label, _, v in rows if label == c])
        m, low = start[c], 1e-3 * x.var(axis=0)
        assert m.variances[0] == pytest.approx(x.var(axis=0)) and all(p.tolist() in x.tolist() for p in m.means)
        w, mu, var = m.weights, m.means, m.variances
        for _ in range(8):
            p = np.stack([w[j] * np.prod(np.exp(-((x - mu[j]) ** 2) / (2 * var[j])) / np.sqrt(2 * np.pi * var[j]), axis=1) for j in range(len(w))], axis=1)
            r = p / p.sum(axis=1, keepdims=True)
            n = r.sum(axis=0)
            w, mu = n / n.sum(), (r.T @ x) / n[:, None]
            var = np.maximum(np.stack([(r[:, j, None] * (x - mu[j]) ** 2).sum(axis=0) / n[j] for j in range(len(n))]), low)
        assert models[c].weights == pytest.approx(w) and models[c].means == pytest.approx(mu) and models[c].variances == pytest.approx(var)
    assert models["c"].weights.tolist() == [1.0]
    tests = df.where("v IS NOT NULL").selectExpr("k AS test", "v AS vector")
    trials = spark.createDataFrame([(c, k) for _, k, _ in rows for c in "ab"] + [("zzz", "a0000"), ("a", "nothing")], "enroll string, test string")
    got = {(r["enroll"], r["test"]): r["score"] for r in mixtures.scores(trials, tests, models).collect()}
    assert len(got) == 2 * len(rows) + 1 and got["zzz", "a0000"] is None
    assert sum((got["a", k] > got["b", k]) == (c == "a") for c, k, _ in rows) > 0.9 * len(rows)
    x = np.array(rows[7][2])
    m = models["a"]
    assert got["a", rows[7][1]] == pytest.approx(np.log(sum(m.weights[j] * np.prod(np.exp(-((x - m.means[j]) ** 2) / (2 * m.variances[j])) / np.sqrt(2 * np.pi * m.variances[j])) for j in range(len(m.weights)))))


def test_mixtures_of_nothing(spark):
    assert mixtures.fitted(spark.createDataFrame([], "c string, k string, v array<double>"), "c", "k", "v", 2) == ({}, [])
