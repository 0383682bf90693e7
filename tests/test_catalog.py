"""Every query with a DuckDB counterpart must agree with it, types included."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, sf, con, name):
    assert differences(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) == []


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
