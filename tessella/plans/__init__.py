"""Registered queries over the test tables: name -> builder, and name -> SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a builder under its own name, with the SQL that gives the same rows where there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


from . import edits, grouped, keyed, language, sampled, scoring, timed, vectors  # noqa: E402, F401
