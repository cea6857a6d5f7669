"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round for comparison: sums of doubles differ in the last places between engines."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def load_all() -> None:
    from pulseloom.catalog import core, detect, evaluate, hourly, knowledge, streams  # noqa: F401
