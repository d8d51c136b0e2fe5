"""Every registered query against its SQL on the same tables."""

import decimal

import duckdb
import pytest

import __spark_entry__
from marketlens.plans import oracle, registry

QUERIES = registry.queries()
ORACLE = oracle.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def plain(value):
    return format(value, "f") if isinstance(value, decimal.Decimal) else repr(value)


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, duck, name):
    result = QUERIES[name](spark, folder)
    rows = result.collect()
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    assert comparable(result.columns, rows) == comparable(columns, cursor.fetchall())
    assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
