"""Checks of keyed tables: each gives rows (rule, key, detail) of what is wrong, and none if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rule: str, key: Column, detail: Column | str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit(detail) if isinstance(detail, str) else detail.cast("string")).alias("detail"))


def unique(rows: DataFrame, key: str) -> DataFrame:
    return violations(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "unique", F.col(key), F.col("n"))


def positive(rows: DataFrame, key: str, value: str) -> DataFrame:
    return violations(rows.where(F.col(value).isNull() | (F.col(value) <= 0)), f"positive {value}", F.col(key), F.col(value))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return violations(a.join(b, key, "left_anti"), "missing on the right", F.col(key), "").unionByName(violations(b.join(a, key, "left_anti"), "missing on the left", F.col(key), ""))


def inverse(lists: DataFrame, rows: DataFrame, group: str, member: str, members: str = "members") -> DataFrame:
    """group -> list must be the exact inverse of member -> group."""
    exploded = lists.select(group, F.explode(members).alias(member))
    pairs = rows.select(group, member)
    detail = F.col(member)
    return violations(exploded.exceptAll(pairs), "only in lists", F.col(group), detail).unionByName(violations(pairs.exceptAll(exploded), "only in rows", F.col(group), detail))


def prefixed_by(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    return violations(rows.where(~F.col(key).cast("string").startswith(F.col(prefix).cast("string"))), f"prefix {prefix}", F.col(key), F.col(prefix))


def ordered(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    return violations(rows.where(F.col(end) <= F.col(start)), "end after start", F.col(key), F.concat_ws(" ", start, end))


def chain_steps(steps: str, allowed: dict[str, set[str]], role: str) -> list[str]:
    """The steps of a chain that its role does not allow."""
    return [s for s in steps.split("-") if s and s.rstrip("0123456789") not in allowed[role]]


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
