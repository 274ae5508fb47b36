"""Every corpus query that SQL can express, against DuckDB."""

import duckdb
import pytest

from shelfcast.llm.queries import ORACLE, QUERIES

TABLES = "documents benchmark pages labels conversations embeddings".split()


@pytest.fixture(scope="module")
def db(root):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, root, db, name):
    frame = QUERIES[name](spark, root)
    result = db.execute(ORACLE[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == sorted(frame.columns)
    expected = sorted(repr(row) for row in result.fetchall())
    assert sorted(repr(tuple(row[c] for c in order)) for row in frame.collect()) == expected


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
