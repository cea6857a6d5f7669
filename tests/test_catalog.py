"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    _, rows, verdict = compare(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict in ("ok", "rows only"), verdict
