"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import compare
import pytest
from conftest import SMALL, plan

import __spark_entry__ as entry
from themeweave.plans.queries import QUERIES

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return compare.open_tables(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    result = entry.queries()[name](spark, SMALL)
    physical = plan(result)
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    found = result.toPandas()
    assert len(found)
    assert compare.differences(found, tables.execute(SQL[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["topic", "rank", "term", "score"]
