"""Every registered query against its SQL, row by row."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests import oracle_check
from verification.queries import QUERIES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def databases():
    return {path: oracle_check.connect(path) for path in (SMALL, MEDIUM)}


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("path", [SMALL, MEDIUM])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, databases, name, path):
    frame = queries()[name](spark, path)
    columns, expected = oracle_check.duckdb_rows(databases[path], oracle_sql()[name])
    assert sorted(frame.columns) == columns
    actual = oracle_check.spark_rows(frame)
    assert len(actual) == len(expected)
    assert actual == expected
    if path == MEDIUM:
        assert expected
