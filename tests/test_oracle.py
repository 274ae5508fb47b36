"""Every value-checked query against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfcast.plans.oracle import ORACLE

TABLES = "region nation customer supplier part orders lineitem events".split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def db(root):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    return connection


def canonical(rows):
    return sorted(tuple(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, root, db, name):
    frame = entry.queries()[name](spark, root)
    columns = sorted(frame.columns)
    result = db.execute(entry.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in result.description}
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert {c: TYPES[t] for c, t in frame.dtypes} == types
    expected = [tuple(row[order.index(c)] for c in columns) for row in result.fetchall()]
    actual = [tuple(row[c] for c in columns) for row in frame.collect()]
    assert canonical(actual) == canonical(expected)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 2405


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
