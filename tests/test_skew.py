"""One key, pipeline or cell holds most of the rows: the work on it is split, and the result is whole."""

from contextlib import contextmanager

import pytest

from facetry.operators.binning import heatmap
from facetry.operators.crossmatch import crossmatch_condition
from facetry.operators.tables import seeded_sample
from facetry.profile import CatalogProfile
from facetry.sources.catalog import write_catalog
from pyspark.sql import functions as F

PROFILE = CatalogProfile(identifiers={"key": "k"})
SMALL_PARTITIONS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
ROWS, HOT = 60_000, 40_000


@contextmanager
def settings(spark, values):
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows have the same key and lie in the same cell."""
    key = F.when(F.col("id") < HOT, F.lit(7)).otherwise(F.col("id"))
    place = F.when(F.col("id") < HOT, F.lit(0.5)).otherwise(F.col("id") / ROWS)
    return spark.range(0, ROWS, numPartitions=8).select(
        "id", key.alias("k"), place.alias("x"), place.alias("y"), F.xxhash64("id").cast("double").alias("v")
    )


@pytest.mark.parametrize("as_text", [False, True])
def test_semi_join_splits_the_hot_key(spark, hot, as_text):
    rows = hot.withColumn("k", F.col("k").cast("string")) if as_text else hot
    listed = spark.range(0, ROWS, 3).select(F.col("id").cast("string").alias("value"))
    lines = listed.unionAll(spark.createDataFrame([("7",)] * 100, "value string"))
    with settings(spark, SMALL_PARTITIONS):
        found = rows.where(crossmatch_condition(rows, lines, "key", "any", PROFILE)).select("id")
        assert found.agg(F.count("*"), F.count_distinct("id")).first() == (HOT + sum(i % 3 == 0 for i in range(HOT, ROWS)),) * 2
        counted = found.groupBy(F.col("id") % 2).count()
        counted.collect()
        plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_pipeline_is_written_by_many_tasks(spark, hot, tmp_path):
    table = hot.withColumn("pipeline", F.when(F.col("k") == 7, "hot").otherwise("cold"))
    path = str(tmp_path / "catalog")
    with settings(spark, SMALL_PARTITIONS):
        write_catalog(table, path, "pipeline", ["k"])
    assert len(list((tmp_path / "catalog" / "pipeline=hot").glob("*.parquet"))) > 3
    assert spark.read.parquet(path).where("pipeline = 'hot'").count() == HOT


def test_median_of_the_hot_cell(spark, hot):
    cells = {(r["x_bin"], r["y_bin"]): r["value"] for r in heatmap(hot, "x", "y", "v", "median", bins=2).collect()}
    low, high = hot.agg(F.min("x"), F.max("x")).first()
    middle = (low + high) / 2
    expected = {
        (0, 0): hot.where(F.col("x") < middle).agg(F.median("v")).first()[0],
        (1, 1): hot.where(F.col("x") >= middle).agg(F.median("v")).first()[0],
    }
    assert cells == pytest.approx(expected)


def test_many_cells_use_no_broadcast(spark, hot):
    """Past the bound on cells the brackets are not broadcast by hint."""
    few = heatmap(hot, "x", "y", "v", "median", bins=240)._jdf.queryExecution().optimizedPlan().toString()
    many = heatmap(hot, "x", "y", "v", "median", bins=241)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in few and "strategy=broadcast" not in many


def test_sample_with_a_hot_key(spark, hot):
    for limit in (10, 5_000, 50_000):
        found = seeded_sample(hot, ["k"], limit)
        assert found.count() == limit
        assert found.select("id").distinct().count() == limit
