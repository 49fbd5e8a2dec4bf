"""Resampling and speed changes of sampled signals by a bank of filters, one a phase, of whole signals or of pieces in order.

A rate of p / q makes p samples out of q: each of p filters, a windowed sinc, is laid over the input every q samples. Output
samples look `width` samples back and `width + q` ahead, so a piece needs that much of its neighbours and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Zero crossings of the sinc to either side, and where it cuts off as a share of the lower of the two highest frequencies: usual values.
CROSSINGS, ROLLOFF = 6, 0.99


class Bank:
    """The filters of a rate."""

    def __init__(self, rate: Fraction, crossings: int = CROSSINGS, rolloff: float = ROLLOFF):
        self.up, self.down = rate.numerator, rate.denominator
        cut = rolloff * min(self.up, self.down)
        self.width = int(np.ceil(crossings * self.down / cut))
        # Seconds, in units of `down` samples, from each output sample to each input sample.
        apart = np.arange(-self.width, self.width + self.down)[None, :] / self.down - np.arange(self.up)[:, None] / self.up
        t = np.clip(apart * cut, -crossings, crossings)
        self.filters = np.sinc(t) * np.cos(np.pi * t / (2 * crossings)) ** 2 * cut / self.down

    @property
    def ahead(self) -> int:
        return self.width + self.down

    def over(self, before: np.ndarray, x: np.ndarray, after: np.ndarray, last: bool) -> np.ndarray:
        """The output of a piece x between the ends of its neighbours (short ones are filled with zeros). All but the last piece are multiples of `down` long."""
        whole = np.concatenate([np.zeros(self.width)[: self.width - len(before)], before[len(before) - min(self.width, len(before)) :], x, after[: self.ahead], np.zeros(self.ahead)[: self.ahead - len(after[: self.ahead])]])
        blocks = -(-len(x) // self.down)
        if not blocks:
            return np.zeros(0)
        frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([whole, np.zeros(self.down)]), self.filters.shape[1])[:: self.down][:blocks]
        out = (frames @ self.filters.T).ravel()
        return out[: -(-len(x) * self.up // self.down)] if last else out


def rate_of(old: float, new: float, most: int = 1000) -> Fraction:
    """new / old as a fraction of numbers up to `most`."""
    return (Fraction(new).limit_denominator(10**6) / Fraction(old).limit_denominator(10**6)).limit_denominator(most)


def pieces_resampled(rows: DataFrame, key: str, piece: str, samples: str, rate: Fraction) -> DataFrame:
    """key, piece and samples at another rate, of signals in pieces that `piece` orders. What the pieces give is what the whole signal gives.

    Pieces but the last of a signal are multiples of rate.denominator long and at least as long as a filter looks; others raise.
    Null samples are an empty piece if they come last. Each piece brings the ends of its neighbours along, so pieces are tasks' rows like any others.
    """
    bank = Bank(rate)
    some = rows.select(F.col(key).alias("key"), F.col(piece).alias("piece"), doubles(samples).alias("x"))
    w = Window.partitionBy("key").orderBy("piece")
    tail = F.slice("x", F.greatest(F.size("x") - bank.width + 1, F.lit(1)), bank.width)
    near = some.select("key", "piece", "x", F.lag(tail).over(w).alias("before"), F.lead(F.slice("x", 1, bank.ahead)).over(w).alias("after"), F.lead("piece").over(w).isNull().alias("last"), F.lead(F.size("x"), 1, 0).over(w).alias("next"), F.lead("piece", 2).over(w).isNull().alias("next_last"))
    return through(near, bank).select(F.col("key").alias(key), F.col("piece").alias(piece), F.col("x").alias(samples))


def doubles(samples: str) -> Column:
    return F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>"))


def through(near: DataFrame, bank: Bank) -> DataFrame:
    """key, piece and x of pieces with the ends of their neighbours, through the bank's filters."""
    kinds = {c: near.schema[c].dataType.simpleString() for c in ("key", "piece")}

    none = np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, before, after, last, next_size, next_last in zip(*(batch.column(c).to_pylist() for c in ("x", "before", "after", "last", "next", "next_last"))):
                if not last and (len(x) % bank.down or (not next_last and next_size < bank.ahead)):
                    raise ValueError(f"pieces must be multiples of {bank.down} samples, and {bank.ahead} at least")
                values = [np.array(v, np.float64) if v is not None else none for v in (before, x, after)]
                out.append(bank.over(*values, last))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32)), pa.array(np.concatenate([none, *out])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("piece"), lists], names=["key", "piece", "x"])

    return near.mapInArrow(run, f"key {kinds['key']}, piece {kinds['piece']}, x array<double>")


def resampled(rows: DataFrame, key: str, samples: str, old: float, new: float) -> DataFrame:
    """key and samples of whole signals at the rate `new` instead of `old`. Null samples are an empty signal; each row is a signal, also where keys repeat."""
    none, no = F.lit(None).cast("array<double>"), F.lit(0)
    near = rows.select(F.col(key).alias("key"), no.alias("piece"), doubles(samples).alias("x"), none.alias("before"), none.alias("after"), F.lit(True).alias("last"), no.alias("next"), F.lit(True).alias("next_last"))
    return through(near, Bank(rate_of(old, new))).select(F.col("key").alias(key), F.col("x").alias(samples))


def at_speed(rows: DataFrame, key: str, samples: str, factor: float) -> DataFrame:
    """key and samples of signals played `factor` times as fast at the same rate; pitch goes along."""
    return resampled(rows, key, samples, factor, 1.0)
