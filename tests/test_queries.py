"""Every query with SQL gives the rows DuckDB finds on the same tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import assert_same
from tests.conftest import DATA

TABLES = sorted(file.stem for file in Path(DATA).glob("*.parquet"))
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return connection


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, database, name):
    assert_same(QUERIES[name](spark, DATA).toPandas(), database.execute(SQL[name]).df())


def test_entry(spark):
    curve = [r["hitrate"] for r in entry.entry(spark).orderBy("k").collect()]
    assert len(curve) == 20 and curve == sorted(curve) and 0 < curve[0] <= curve[-1] <= 1
