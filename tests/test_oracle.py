"""Every query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_points

QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, tables, name):
    assert compare(QUERIES[name](spark, sf), tables, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_flagship(spark):
    assert entry_points.entry(spark).columns == ["x_bin", "y_bin", "x", "y", "value"]
