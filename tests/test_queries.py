"""Every registered query against its check SQL at the smallest scale."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from ridelake.catalog import load_queries
from ridelake.catalog.registry import complete_sql, runner
from ridelake.catalog.roles import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_queries()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, Decimal)):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return str(value)


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_query_matches_sql(spark, database, name):
    df = runner(QUERIES[name])(spark, FOLDER)
    found = df.collect()
    expected = database.execute(complete_sql(QUERIES[name].sql))
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(found, df.columns) == canonical(expected.fetchall(), names)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None])
def test_query_without_sql_runs(spark, name):
    assert runner(QUERIES[name])(spark, FOLDER).count() > 0
