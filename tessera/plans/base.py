"""The table of registered queries that the modules of this package fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)
