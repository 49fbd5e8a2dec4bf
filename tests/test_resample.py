"""Resampling: sines stay sines, pieces give what the whole gives, and a plain sum over all samples."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import resample


def plain(x, rate, crossings=6, rolloff=0.99):
    """Each output sample as a sum over the whole input."""
    p, q = rate.numerator, rate.denominator
    cut = rolloff * min(p, q) / q  # zero crossings a sample
    out = []
    for m in range(-(-len(x) * p // q)):
        t = np.clip((np.arange(len(x)) - m * q / p) * cut, -crossings, crossings)
        out.append((x * np.sinc(t) * np.cos(np.pi * t / (2 * crossings)) ** 2 * cut).sum())
    return np.array(out)


RATES = [Fraction(1, 2), Fraction(2, 1), Fraction(3, 2), Fraction(10, 11), Fraction(441, 480)]


@pytest.mark.parametrize("rate", RATES)
def test_against_a_plain_sum(spark, rate):
    rng = np.random.default_rng(1)
    signals = {k: rng.normal(size=n) for k, n in (("a", 700), ("b", 1), ("c", 0), ("d", rate.denominator), ("e", 333))}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in signals.items()] + [("null", None)], "k string, x array<double>")
    got = {r["k"]: r["x"] for r in resample.resampled(rows, "k", "x", rate.denominator, rate.numerator).collect()}
    assert got["null"] == [] and len(got) == 6
    for k, v in signals.items():
        assert got[k] == pytest.approx(plain(v, rate), abs=1e-9)


@pytest.mark.parametrize("rate", RATES)
def test_pieces_give_what_the_whole_gives(spark, rate):
    x = np.random.default_rng(2).normal(size=6000)
    least = resample.Bank(rate).ahead
    size = -(-least // rate.denominator) * rate.denominator
    pieces = [(k, i, v.tolist()) for k, n in (("a", 6000), ("b", 4 * size), ("c", size + 1), ("d", 5)) for i, v in enumerate(np.split(x[:n], range(size, n, size)))]
    rows = spark.createDataFrame(pieces, "k string, i int, x array<double>").repartition(7)
    got = {}
    for r in sorted(resample.pieces_resampled(rows, "k", "i", "x", rate).collect(), key=lambda r: r["i"]):
        got.setdefault(r["k"], []).extend(r["x"])
    for k, n in (("a", 6000), ("b", 4 * size), ("c", size + 1), ("d", 5)):
        assert got[k] == pytest.approx(plain(x[:n], rate), abs=1e-9)


def test_sines_and_speed(spark):
    at = np.arange(16_000) / 16_000
    rows = spark.createDataFrame([("s", np.sin(2 * np.pi * 440 * at).tolist())], "k string, x array<double>")
    down = np.array(resample.resampled(rows, "k", "x", 16_000, 8_000).first()["x"])
    assert len(down) == 8000 and np.abs(down - np.sin(2 * np.pi * 440 * np.arange(8000) / 8000))[50:-50].max() < 2e-3
    high = spark.createDataFrame([("s", np.sin(2 * np.pi * 6000 * at).tolist())], "k string, x array<double>")
    assert np.abs(resample.resampled(high, "k", "x", 16_000, 8_000).first()["x"])[50:-50].max() < 2e-2  # above the new highest frequency
    fast = np.array(resample.at_speed(rows, "k", "x", 1.1).first()["x"])
    assert len(fast) == -(-16_000 * 10 // 11) and np.abs(fast - np.sin(2 * np.pi * 484 * np.arange(len(fast)) / 16_000))[50:-50].max() < 2e-3


def test_uneven_pieces_raise(spark):
    rows = spark.createDataFrame([("a", 0, [1.0] * 45), ("a", 1, [1.0] * 44), ("a", 2, [1.0])], "k string, i int, x array<double>")
    with pytest.raises(Exception, match="multiples of 2"):
        resample.pieces_resampled(rows, "k", "i", "x", Fraction(1, 2)).collect()
    assert resample.resampled(rows.where("false").select("k", "x"), "k", "x", 2, 1).count() == 0 and F is not None
