"""Physical plans of all queries: nothing that grows faster than the tables, no Python in a task."""

import pytest

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
FORBIDDEN = ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas", "ArrowEval")
WRITERS = {"export_manifest", "export_roundtrip", "stream_subset_count"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_forbidden_node(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert not [word for word in FORBIDDEN if word in plan]


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("heatmap_mean", "l_quantity:double,l_extendedprice:double,l_discount:double"),
        ("hist_numeric", "l_extendedprice:double"),
        ("select_columns", "o_orderkey:bigint,o_orderstatus:string,o_totalprice:double"),
        ("subset_count", "l_quantity:double,l_returnflag:string"),
        ("target_bitwise", "p_partkey:bigint"),
    ],
)
def test_only_used_columns_are_read(spark, sf, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan_of(QUERIES[name](spark, sf))


@pytest.mark.parametrize(
    ("name", "filters"),
    [
        ("expr_compare", "GreaterThanOrEqual(l_quantity,25.0)"),
        ("expr_range", "GreaterThan(l_quantity,10.0), LessThanOrEqual(l_quantity,20.0)"),
        ("dataset_slice", "EqualTo(l_returnflag,N)"),
        ("viewport", "LessThan(l_extendedprice,50000.0)"),
        ("select_hist_cat", "In(o_orderpriority, [1-URGENT,5-LOW])"),
    ],
)
def test_filters_reach_the_reader(spark, sf, name, filters):
    assert filters in plan_of(QUERIES[name](spark, sf))


@pytest.mark.parametrize(("name", "shuffles"), [("heatmap_mean", 1), ("describe", 2), ("viewport", 0), ("target_and", 0)])
def test_number_of_shuffles(spark, sf, name, shuffles):
    """A binned view shuffles its cells once; its limits are one row per task. ``describe`` joins two tables' rows."""
    plan = plan_of(QUERIES[name](spark, sf))
    assert plan.count("Exchange hashpartitioning") + (plan.count("Exchange Single") if name == "describe" else 0) == shuffles
