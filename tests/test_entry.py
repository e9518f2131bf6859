"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lexmill.plans.registry import ORACLES, QUERIES
from tests.oracle import SMALL, same_rows


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "tier", "n_sources", "n_duplicates"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
