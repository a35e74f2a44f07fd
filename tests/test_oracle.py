"""Every query with oracle SQL agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from oracle import compare, duck

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    ok, tolerant, msg = compare(spark, con, name, QUERIES[name], SQL[name], SMALL)
    assert tolerant, msg


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "l_returnflag" in df.columns
