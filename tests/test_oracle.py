"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest

from changemap.plans import catalog
from tools.check_oracle import compare, connect

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    ok, note = compare(QUERIES[name](spark, sf), con.execute(SQL[name]))
    assert ok, note
