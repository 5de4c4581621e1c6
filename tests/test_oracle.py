"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from conftest import TESTDATA

from tillwise.registry import oracle_sql, queries

SF_DIR = os.environ.get("TILLWISE_SF_DIR", f"{TESTDATA}/sf0.01")
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def _normal(rows, columns):
    """Rows as sorted tuples of exact texts, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_all_queries_have_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    expected = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert {c: SQL_TYPES[t] for c, t in frame.dtypes} == {d[0]: str(d[1]) for d in expected.description}
    wanted = _normal(expected.fetchall(), columns)
    got = _normal([tuple(r) for r in frame.collect()], frame.columns)
    assert len(got) == len(wanted)
    assert got == wanted
    assert wanted
