"""Where the queries register themselves with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixture import options, with_options

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain_sql: str | None = None):
    """Register a function of (spark, sf_dir). ``sql`` may read ``options``, ``plain_sql`` may not."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_options(sql)
        if plain_sql:
            SQL[name] = plain_sql
        return fn

    return add


def on_options(name: str, sql: str | None = None):
    """Register a function of the options frame."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        query(name, sql)(lambda spark, sf_dir: fn(options(spark, sf_dir)))
        return fn

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round columns, since engines add doubles in different orders."""
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def nullable(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers with nulls as doubles, which all clients read alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})
