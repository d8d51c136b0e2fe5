"""The registered corpus queries against their SQL."""

import duckdb
import pytest

from marketlens.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_and_sql(spark, folder, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(tuple(r[c] for c in columns) for r in found.collect())
    assert rows == sorted(cursor.fetchall())
