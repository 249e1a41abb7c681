"""Every core query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

from skarn import queries
from tests.compare import DATA, compare, connect

FOLDER = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    mine, theirs, only_mine, only_theirs = compare(queries.QUERIES[name](spark, FOLDER), queries.SQL[name], con)
    assert (mine, only_mine, only_theirs) == (theirs, [], [])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
