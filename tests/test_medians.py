"""Medians by sketches and ranks: exact for every distribution and size of group."""

import statistics

import pytest
from pyspark.sql import functions as F

from facetry.operators import quantiles
from facetry.operators.binning import heatmap
from facetry.operators.quantiles import approximate_median, grouped_median

ROWS = 200_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Groups of very different distributions; most rows are in one."""
    name = F.array(*[F.lit(n) for n in ("wide", "heavy", "two", "same", "tiny")])
    group = F.when(F.col("id") < 3, "tiny").when(F.col("id") % 10 < 6, "wide").otherwise(name[F.col("id") % 4])
    normal = F.randn(7)
    value = (
        F.when(F.col("g") == "wide", F.exp(normal * 3))
        .when(F.col("g") == "heavy", F.exp(normal))
        .when(F.col("g") == "two", F.when(F.col("id") % 7 < 3, -1.0).otherwise(2.0))
        .when(F.col("g") == "same", F.lit(7.5))
        .otherwise(F.when(F.col("id") == 2, float("inf")).otherwise(-0.0))
    )
    rows = spark.range(0, ROWS, numPartitions=6).select("id", group.alias("g")).select("g", value.alias("v"))
    return rows.cache()


def medians(frame):
    return {r["g"]: r["median"] for r in frame.collect()}


@pytest.fixture(scope="module")
def expected(skewed):
    found = {}
    for g, v in skewed.collect():
        found.setdefault(g, []).append(v)
    return {g: statistics.median(v) for g, v in found.items()}


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("large", [quantiles.LARGE, 1_000])
def test_medians_of_every_distribution(skewed, expected, monkeypatch, few, large):
    monkeypatch.setattr(quantiles, "LARGE", large)
    assert medians(grouped_median(skewed, ["g"], F.col("v"), few)) == expected


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000])
def test_medians_around_the_size_of_a_sketch(spark, n):
    rows = spark.range(n).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    assert medians(grouped_median(rows, ["g"], F.col("v"), True)) == {1: (n - 1) / 2}
    about = medians(approximate_median(rows, ["g"], F.col("v")))[1]
    assert abs(about - (n - 1) / 2) <= max(0.01 * n, 0)


def test_missing_values_and_no_rows(spark):
    rows = spark.createDataFrame([(1, None), (1, 3.0), (2, None)], "g int, v double")
    assert medians(grouped_median(rows, ["g"], F.col("v"), True)) == {1: 3.0}
    assert medians(grouped_median(rows.limit(0), ["g"], F.col("v"), False)) == {}
    assert medians(approximate_median(rows, ["g"], F.col("v"))) == {1: 3.0}


@pytest.mark.parametrize("g", ["wide", "heavy"])
def test_less_than_one_value_in_a_hundred_is_ranked(skewed, g):
    values = skewed.where(F.col("g") == g)
    _, _, low, high = quantiles._sketched(values, ["g"]).first()["at"]
    assert values.where(F.col("v").between(low, high)).distinct().count() < 0.01 * values.distinct().count()


@pytest.mark.parametrize(("low", "high"), [(1e9, 1e10), (-1e10, -1e9)])
def test_a_median_outside_its_first_range_is_found(skewed, expected, low, high):
    """A first sketch that is wrong on either side only costs time, when a group is narrowed again."""
    values = skewed.where("g = 'wide' or g = 'two'")
    ranges = values.groupBy("g").agg(F.count("*").alias("size"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    narrow = quantiles._narrowed(values, ranges, ["g"], True)
    found = medians(quantiles._ranked(values, narrow, ["g"], True))
    assert found == {g: expected[g] for g in ("wide", "two")}
    with pytest.raises(Exception, match="outside its range"):
        quantiles._ranked(values, ranges, ["g"], True).collect()


def test_approximate_medians_by_rank(skewed):
    about = medians(approximate_median(skewed, ["g"], F.col("v")))
    for g, value in about.items():
        below, upto = skewed.where(F.col("g") == g).agg(F.avg((F.col("v") < value).cast("int")), F.avg((F.col("v") <= value).cast("int"))).first()
        assert below <= 0.51 and upto >= 0.49


def shuffled_rows(df):
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_fine_map_sends_few_rows(spark):
    rows = spark.range(0, 1_000_000, numPartitions=4).select(F.rand(1).alias("x"), F.rand(2).alias("y"), F.exp(F.randn(3) * 3).alias("v"))
    limits = {"x": (0, 1), "y": (0, 1)}
    assert shuffled_rows(heatmap(rows, "x", "y", "v", "median", 100, limits)) < 100_000
