"""Vectors as arrays of double, and token arrays: expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """v scaled to length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def argmax(v: Column) -> Column:
    """Zero-based place of the first greatest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words as arrays; none if there are fewer words."""
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(words, i, n))).otherwise(F.array().cast("array<array<string>>"))


def mapped(tokens: Column, mapping: Column, missing: Column | None = None) -> Column:
    """Each token through a map column; a token that is not in it becomes `missing`, or stays."""
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(mapping, t), missing if missing is not None else t))


def words(text: Column) -> Column:
    """Runs of anything but blanks; no words for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)), F.array().cast("array<string>"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column, damping: float = 0.0) -> Column:
    q = p * (1 - 2 * damping) + damping if damping else p
    return F.ln(q / (F.lit(1.0) - q))


def decibel_to_amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone, whatever the partitions."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
