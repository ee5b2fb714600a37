import math
import random
import statistics

import pytest
from conftest import TEXT_ID, close

from facetry.errors import EmptySubsetError, FacetryError
from facetry.functions.expressions import condition
from facetry.operators import ranges, tables
from facetry.operators.binning import cell_widths, heatmap, histogram, histogram_centers, histogram_edges, limits_of
from facetry.operators.categories import category_codes, category_guard, with_codes
from facetry.operators.compare import compare_subsets
from facetry.operators.crossfilter import CrossFilter
from facetry.operators.quantiles import approximate_median, grouped_median
from facetry.operators.selections import select_bars, select_categories, select_cells, select_points, viewport
from facetry.operators.summaries import (
    describe,
    distinct_count,
    minmax,
    pivot_counts,
    require_rows,
    require_values,
    subset_count,
    subset_progress,
    unique_values,
    value_counts,
)
from facetry.operators.tables import page, page_after, scatter_points, seeded_sample, seeded_shuffle
from facetry.plans.request import run_params, run_request
from facetry.plans.subset import SubsetSpec
from facetry.plans.view import ViewSpec
from facetry.profile import SURVEY, TARGET_ID, CatalogProfile
from pyspark.sql import functions as F

INF = float("inf")
SAMPLE = [(i, random.Random(i).gauss(0, 3), random.Random(-i).random() ** 3, "abc"[i % 3]) for i in range(1, 400)]
SAMPLE += [(1000, math.nan, 0.5, "a"), (1001, None, 0.5, "b"), (1002, INF, 0.2, "c"), (1003, 0.5, math.nan, None)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(SAMPLE, "id bigint, x double, y double, kind string").cache()


def known(value):
    return value is not None and math.isfinite(value)


def bin_of(value, values, bins):
    low, high = min(values), max(values)
    return 0 if low == high else min(int((value - low) / (high - low) * bins), bins - 1)


# Histograms -------------------------------------------------------------------------------------


@pytest.mark.parametrize("bins", [1, 7, 20])
def test_histogram(points, bins):
    xs = [x for _, x, _, _ in SAMPLE if known(x)]
    expected = [0] * bins
    for x in xs:
        expected[bin_of(x, xs, bins)] += 1
    found = {r["x_bin"]: r for r in histogram(points, "x", bins, dense=True).collect()}
    assert [found[i]["n"] for i in range(bins)] == expected
    width = (max(xs) - min(xs)) / bins
    assert all(close(found[i]["x"], min(xs) + (i + 0.5) * width) for i in range(bins))
    assert sum(r["n"] for r in histogram(points, "x", bins).collect()) == len(xs)


def test_left_closed_loses_only_the_maximum(points):
    xs = [x for _, x, _, _ in SAMPLE if known(x)]
    assert sum(r["n"] for r in histogram(points, "x", 10, closed="left").collect()) == len(xs) - 1


def test_histogram_with_given_limits(points):
    xs = [x for _, x, _, _ in SAMPLE if known(x) and -1 <= x <= 1]
    found = histogram(points, "x", 4, limits=(-1, 1), dense=True).orderBy("x_bin").collect()
    assert [r["x"] for r in found] == [-0.75, -0.25, 0.25, 0.75]
    assert sum(r["n"] for r in found) == len(xs)


def test_constant_column_is_one_bin(stars):
    assert [tuple(r) for r in histogram(stars, "same", 5).collect()] == [(0, 7.0, 30)]


def test_categorical_histogram(points):
    found = histogram(points, "kind", dense=True).orderBy("x_bin").collect()
    assert [tuple(r) for r in found] == [(0, "a", 134), (1, "b", 134), (2, "c", 134)]


def test_boolean_histogram(stars):
    found = histogram(stars, "good").orderBy("x_bin").collect()
    assert [(r["x"], r["n"]) for r in found] == [(False, 19), (True, 10)]


def test_no_rows(points):
    none = points.where("id < 0")
    assert histogram(none, "x", 5).count() == 0
    assert [r["n"] for r in histogram(none, "x", 5, dense=True).collect()] == [0] * 5
    assert histogram(none, "kind", dense=True).count() == 0
    assert heatmap(none, "x", "y", statistic="count", bins=3).count() == 0


def test_edges_and_centers(points):
    edges = [r["edge"] for r in histogram_edges(points, "x", 4, (0, 8)).orderBy("i").collect()]
    assert edges == [0, 2, 4, 6, 8]
    centers = [r["center"] for r in histogram_centers(points, "x", 4, (0, 8)).orderBy("i").collect()]
    assert centers == [1, 3, 5, 7]
    assert [r["edge"] for r in histogram_edges(points, "kind").orderBy("i").collect()] == [-0.5, 0.5, 1.5, 2.5]
    assert [r["center"] for r in histogram_centers(points, "kind").orderBy("i").collect()] == [0, 1, 2]


def test_bad_bins(points):
    with pytest.raises(FacetryError):
        histogram(points, "x", 0)
    with pytest.raises(FacetryError):
        histogram(points, "x", 5, closed="right")


# Heat maps --------------------------------------------------------------------------------------

REDUCE = {
    "mean": statistics.fmean,
    "median": statistics.median,
    "sum": math.fsum,
    "min": min,
    "max": max,
}


def cells_of(rows, bins):
    xs = [r[1] for r in rows if known(r[1])]
    ys = [r[2] for r in rows if known(r[2])]
    cells = {}
    for i, x, y, _ in rows:
        if known(x) and known(y):
            cells.setdefault((bin_of(x, xs, bins), bin_of(y, ys, bins)), []).append(float(i))
    return cells


@pytest.mark.parametrize("statistic", list(REDUCE))
def test_heatmap(points, statistic):
    found = {(r["x_bin"], r["y_bin"]): r["value"] for r in heatmap(points, "x", "y", "id", statistic, bins=6).collect()}
    expected = {cell: REDUCE[statistic](v) for cell, v in cells_of(SAMPLE, 6).items()}
    assert found.keys() == expected.keys()
    assert all(close(found[c], expected[c]) for c in found)


def test_heatmap_count_dense_and_log(points):
    cells = cells_of(SAMPLE, 6)
    dense = heatmap(points, "x", "y", statistic="count", bins=6, dense=True).collect()
    assert len(dense) == 36
    assert {(r["x_bin"], r["y_bin"]): r["value"] for r in dense if r["value"]} == {c: len(v) for c, v in cells.items()}
    logs = heatmap(points, "x", "y", statistic="count", bins=6, log=True).collect()
    assert all(close(r["value"], math.log10(len(cells[r["x_bin"], r["y_bin"]]))) for r in logs)


def test_missing_values_in_cells(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 1.0), (0.0, 0.0, math.nan), (0.0, 0.0, None), (1.0, 1.0, math.nan), (1.0, 0.0, INF)],
        "x double, y double, v double",
    )
    for statistic in ("mean", "median", "sum", "min", "max"):
        cells = {(r["x_bin"], r["y_bin"]): r["value"] for r in heatmap(df, "x", "y", "v", statistic, 2, dense=True).collect()}
        assert cells == {(0, 0): 1.0, (0, 1): None, (1, 0): None, (1, 1): None}, statistic
    counts = {(r["x_bin"], r["y_bin"]): r["value"] for r in heatmap(df, "x", "y", statistic="count", bins=2).collect()}
    assert counts == {(0, 0): 3, (1, 1): 1, (1, 0): 1}


def test_heatmap_with_categories(points):
    found = heatmap(points, "kind", "y", "id", "max", bins=4)
    assert {r["x"] for r in found.collect()} == {"a", "b", "c"}
    both = heatmap(points, "kind", "kind", "id", "max", dense=True).collect()
    assert len(both) == 9 and sum(r["value"] is not None for r in both) == 3


def test_heatmap_errors(points):
    for wrong in (
        {"statistic": "mode", "value": "id"},
        {"statistic": "mean"},
        {"statistic": "mean", "value": "kind"},
    ):
        with pytest.raises(FacetryError):
            heatmap(points, "x", "y", **wrong)


def test_widths(points, stars):
    assert tuple(cell_widths(stars, "telescope", "ra", 10).first()) == (1.0, pytest.approx(34.8))


def test_approximate_median_is_near(points):
    exact = {(r["x_bin"], r["y_bin"]): r["value"] for r in heatmap(points, "x", "y", "id", "median", 3).collect()}
    near = heatmap(points, "x", "y", "id", "median", 3, approximate=True).collect()
    assert all(abs(exact[r["x_bin"], r["y_bin"]] - r["value"]) <= 12 for r in near)


@pytest.mark.parametrize("few", [True, False])
def test_median_of_a_hot_group(spark, few):
    """One group holds most rows, another one value over and over; even and odd sizes."""
    numbers = random.Random(1)
    rows = [(0, numbers.lognormvariate(0, 2)) for _ in range(20_001)]
    rows += [(1, 5.0)] * 5_000 + [(1, numbers.random()) for _ in range(100)]
    rows += [(2, float(i)) for i in range(10)] + [(3, None), (4, 1.0), (5, 1.0), (5, 2.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    found = {r["k"]: r["median"] for r in grouped_median(df, ["k"], F.col("v"), few_groups=few).collect()}
    expected = {}
    for k in (0, 1, 2, 4, 5):
        expected[k] = statistics.median(v for key, v in rows if key == k)
    assert found == pytest.approx(expected)


# Categories -------------------------------------------------------------------------------------


def test_codes(points):
    assert {r["kind"]: r["code"] for r in with_codes(points, "kind").where("kind is not null").collect()} == {
        "a": 0,
        "b": 1,
        "c": 2,
    }
    assert [tuple(r) for r in category_codes(points, "kind").orderBy("code").collect()] == [("a", 0), ("b", 1), ("c", 2)]


def test_too_many_categories(stars):
    with pytest.raises(Exception, match="10 or more categories"):
        histogram(stars, TEXT_ID).collect()
    with pytest.raises(FacetryError, match="not categorical"):
        with_codes(stars, "ra")
    assert histogram(stars, TEXT_ID, category_limit=31).count() == 30
    guard = {r["column"]: (r["n_distinct"], r["allowed"]) for r in category_guard(stars, ["release", "ra"]).collect()}
    assert guard == {"release": (3, True), "ra": (30, False)}


# Selections -------------------------------------------------------------------------------------


def test_bars_hold_the_rows_of_the_histogram(points):
    counts = {r["x_bin"]: r["n"] for r in histogram(points, "x", 8, dense=True).collect()}
    ends = limits_of(points, ["x"])["x"]
    for chosen in ([0], [7], [2, 3, 4], [5, 3], list(range(8))):
        test = select_bars(points, "x", ends, 8, chosen)
        bars = range(min(chosen), max(chosen) + 1)
        assert points.where(test).count() == sum(counts[b] for b in bars)


def test_bars_by_centers_lose_the_outer_halves(points):
    wide = points.where(select_bars(points, "x", (-4.0, 4.0), 8, [2, 5]))
    narrow = points.where(select_bars(points, "x", (-4.0, 4.0), 8, [2, 5], mode="centers"))
    assert {r["id"] for r in wide.collect()} == {i for i, x, _, _ in SAMPLE if known(x) and -2 <= x < 2}
    assert {r["id"] for r in narrow.collect()} == {i for i, x, _, _ in SAMPLE if known(x) and -1.5 <= x <= 1.5}
    with pytest.raises(FacetryError):
        select_bars(points, "x", (0, 1), 8, [1], mode="middles")


def test_cells_and_categories(points):
    box = select_cells(points, select_categories("kind", ["a", "c"]), select_bars(points, "y", (0.0, 1.0), 4, [1, 2]))
    expected = {i for i, _, y, k in SAMPLE if k in ("a", "c") and known(y) and 0.25 <= y < 0.75}
    assert {r["id"] for r in points.where(box).collect()} == expected


def test_points_by_pair_and_independent(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 2.0), (4, math.nan, 1.0)], "id int, x double, y double")
    chosen = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 2.0), (math.nan, 1.0)], "x double, y double")
    pairs = df.where(select_points(df, "x", "y", chosen))
    loose = df.where(select_points(df, "x", "y", chosen, mode="independent"))
    assert {r["id"] for r in pairs.collect()} == {1, 2}
    assert {r["id"] for r in loose.collect()} == {1, 2, 3}


def test_points_in_a_crossfilter(points):
    chosen = points.where("id <= 5").select("x", "y")
    views = CrossFilter()
    views.set("scatter", select_points(points, "x", "y", chosen))
    views.set("hist", F.col("kind") == "a")
    assert {r["id"] for r in views.frame_for(points, "hist").collect()} == {1, 2, 3, 4, 5}
    assert {r["id"] for r in views.frame_for(points).collect()} == {3}
    either = views.frame_for(points, None, lambda a, b: a | b)
    assert {r["id"] for r in either.collect()} == {1, 2, 3, 4, 5} | {i for i, _, _, k in SAMPLE if k == "a"}


def test_viewport(points):
    inside = {r["id"] for r in points.where(viewport(points, "x", (2, -1), "y", (0, 0.5))).collect()}
    assert inside == {i for i, x, y, _ in SAMPLE if known(x) and known(y) and -1 < x < 2 and 0 < y < 0.5}
    assert viewport(points) is None
    assert viewport(points, "kind", (0, 1)) is None


# Statistics and ranges --------------------------------------------------------------------------


def test_counts(points):
    assert subset_count(points).first()[0] == len(SAMPLE)
    assert subset_count(points, F.col("id") <= 10).first()[0] == 10
    assert subset_progress(points, F.col("id") <= 10).first() == (10, len(SAMPLE), pytest.approx(1000 / len(SAMPLE)))
    assert subset_progress(points.where("id < 0"), F.col("id") <= 10).first() == (0, 0, 0.0)


def test_describe(stars, rows):
    found = {r["column"]: r for r in describe(stars, ["teff", "logg", "flag_bad", "release"]).collect()}
    assert list(found) == ["teff", "logg", "flag_bad"]
    for name in found:
        values = [r[name] for r in rows if r[name] is not None and not math.isnan(r[name])]
        row = found[name]
        assert (row["count"], row["na"]) == (len(values), 30 - len(values))
        assert close(row["mean"], statistics.fmean(values), 6) and close(row["std"], statistics.pstdev(values), 6)
        assert (row["min"], row["max"]) == (min(values), max(values))
    assert found["teff"]["data_type"] == "float"
    with pytest.raises(FacetryError):
        describe(stars, ["release"])


def test_values(stars):
    assert minmax(stars, "logg").first() == (0.0, 4.75)
    assert distinct_count(stars, "release").first()[0] == 3
    assert {r[0] for r in unique_values(stars, "telescope").collect()} == {"apo25m", "lco25m"}
    assert [r[0] for r in unique_values(stars, "release", 2).collect()] == ["old one", "other"]
    assert [tuple(r) for r in value_counts(stars, "release").collect()][0] == (SURVEY, 20)
    assert {r["telescope"]: (r[SURVEY], r["other"]) for r in pivot_counts(stars, "telescope", "release").collect()}
    with pytest.raises(FacetryError):
        pivot_counts(stars, "telescope", TEXT_ID)


def test_axis_ranges(stars, points):
    ras = [i * 12.0 for i in range(30)]
    span = max(ras)
    assert ranges.axis_range(stars, "ra").first() == pytest.approx((-span / 20, span * 21 / 20))
    assert ranges.axis_range(stars, "ra", "heatmap", flip=True).first() == (span, 0.0)
    assert ranges.axis_range(stars, "release", "heatmap").first() == (-0.5, 2.5)
    assert ranges.axis_range(stars, "release", "histogram").first() == pytest.approx((-1.2, 3.2))
    assert ranges.axis_range(stars, "release").first() == pytest.approx((-0.1, 2.1))
    pad = math.log10(2.5 / 1.25) / 20
    assert ranges.axis_range(stars, "plx", log=True).first() == pytest.approx((1.25 / 10**pad, 2.5 * 10**pad))


def test_color_ranges(stars, points):
    cells = heatmap(stars, "ra", "dec", statistic="count", bins=3)
    assert ranges.heatmap_color_range(cells, "count").first() == (0.0, 10.0)
    assert ranges.heatmap_color_range(cells, "mean").first() == (10.0, 10.0)
    assert ranges.scatter_color_range(stars, "release").first() == (0.0, 2.0)
    assert ranges.scatter_color_range(stars, "logg").first() == (0.0, 4.75)
    assert ranges.scatter_color_range(stars, "plx", log=True).first() == pytest.approx((math.log10(1.25), math.log10(2.5)))
    assert ranges.count_axis_range(histogram(stars, "same", 5)).first() == pytest.approx((0.0, 36.0))
    assert ranges.count_axis_range(histogram(stars, "same", 5), log=True).first() == pytest.approx((1.0, 36.0))


def test_compare_equals_separate_scans(stars):
    subsets = {"all": None, "warm": condition(stars, "teff > 5000"), "none": condition(stars, "ra < -1")}
    for statistic, value in (("count", None), ("mean", "snr"), ("max", "logg"), ("median", "snr")):
        limits = {"ra": (0.0, 348.0), "dec": (-90.0, 90.0)}
        together = {}
        for r in compare_subsets(stars, subsets, "ra", "dec", value, statistic, 4, limits).collect():
            together[r["subset"], r["x_bin"], r["y_bin"]] = r["value"]
        alone = {}
        for name, test in subsets.items():
            rows = stars if test is None else stars.where(test)
            for r in heatmap(rows, "ra", "dec", value, statistic, 4, limits).collect():
                alone[name, r["x_bin"], r["y_bin"]] = r["value"]
        assert together == pytest.approx(alone)
    with pytest.raises(FacetryError, match="categorical"):
        compare_subsets(stars, subsets, "ra", "dec", "release", "median")
    dense = compare_subsets(stars, subsets, "ra", "dec", "snr", "median", 4, dense=True)
    assert dense.count() == 3 * 16 and dense.where("subset = 'none' and value is null").count() == 16


@pytest.mark.parametrize("key", ["name", "value", "number", "same"])
def test_pages_of_any_key(spark, key, monkeypatch):
    monkeypatch.setattr(tables, "FEW_ROWS", 0)
    monkeypatch.setattr(tables, "RANGE_ROWS", 20)
    r = random.Random(8)
    rows = [
        (r.choice(["a", "ab", "abc", "abd", "b", "ba", None, ""]) , r.choice([1.5, -2.0, math.nan, math.inf, -math.inf, None, r.random()]),
         r.choice([-(2**63), 2**63 - 1, 6 * 10**18 + r.randint(0, 900), None]), 7, i)
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "name string, value double, number bigint, same int, id int").repartition(4)
    ids = [x["id"] for n in range(5) for x in page(df, [key], n, 30, ["id"]).orderBy("row").collect()]
    assert sorted(ids) == list(range(150))
    order = [x["id"] for x in df.orderBy(key).select(key, "id").collect()]
    value = {row[4]: row[["name", "value", "number", "same"].index(key)] for row in rows}
    assert [str(value[i]) for i in ids] == [str(value[i]) for i in order]


def test_views_without_data_are_errors_on_demand(stars):
    profile = CatalogProfile()
    for kind in ("histogram", "heatmap", "scatter"):
        view = ViewSpec(kind, x="ra", y="dec", color="teff")
        assert view.compile(stars.where("ra < -1"), profile).isEmpty()
        with pytest.raises(EmptySubsetError):
            view.compile(stars.where("ra < -1"), profile, require=True)
    without = stars.withColumn("teff", F.lit(None).cast("float"))
    with pytest.raises(EmptySubsetError):
        ViewSpec("heatmap", x="ra", y="dec", color="teff").compile(without, profile, require=True)


def test_median_sends_counts_not_values(spark):
    """A hot cell of different values: what is shuffled stays far below the values."""
    rows = spark.range(0, 400_000, 1, 8).select(F.when(F.col("id") % 100 == 0, 1).otherwise(0).alias("k"), F.rand(5).alias("v"))
    exact = {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r["k"]: r["median"] for r in grouped_median(rows, ["k"], F.col("v"), True).collect()} == pytest.approx(exact)
    assert {r["k"]: r["median"] for r in grouped_median(rows, ["k"], F.col("v")).collect()} == pytest.approx(exact)
    near = {r["k"]: r["median"] for r in approximate_median(rows, ["k"], F.col("v"), True).collect()}
    assert near == pytest.approx(exact, abs=1e-3)


# Tables -----------------------------------------------------------------------------------------


def test_shuffle_does_not_depend_on_partitions(points):
    orders = [[r["id"] for r in seeded_shuffle(points.repartition(n), ["id"]).collect()] for n in (1, 3)]
    assert orders[0] == orders[1] and orders[0] != sorted(orders[0])
    other = [r["id"] for r in seeded_shuffle(points, ["id"], seed=1).collect()]
    assert other != orders[0] and sorted(other) == sorted(orders[0])


@pytest.mark.parametrize("limit", [1, 50, 402, 403, 1000])
def test_sample_is_the_head_of_the_shuffle(points, limit):
    head = [r["id"] for r in seeded_shuffle(points, ["id"]).limit(limit).collect()]
    assert [r["id"] for r in seeded_sample(points, ["id"], limit).collect()] == head


def test_sample_of_nothing_and_of_copies(spark):
    df = spark.range(0).withColumn("v", F.lit(1))
    assert seeded_sample(df, ["id"], 10).count() == 0
    copies = spark.range(0, 100, numPartitions=5).select(F.when(F.col("id") < 80, 7).otherwise(F.col("id")).alias("id"))
    for limit in (1, 10, 90, 100):
        head = [r["id"] for r in seeded_shuffle(copies, ["id"]).limit(limit).collect()]
        assert [r["id"] for r in seeded_sample(copies, ["id"], limit).collect()] == head


def test_scatter(stars):
    found = scatter_points(stars, "ra", "dec", "plx", ["gaia_dr3_source_id"], log_color=True)
    assert found.columns == ["x", "y", "color", "gaia_dr3_source_id"]
    rows = found.collect()
    assert len(rows) == 30 and sum(r["color"] is None for r in rows) == 16


@pytest.mark.parametrize("spread", ["even", "uneven", "one value", "copies"])
def test_deep_pages(spark, spread, monkeypatch):
    monkeypatch.setattr(tables, "FEW_ROWS", 5)
    monkeypatch.setattr(tables, "RANGE_ROWS", 12)
    monkeypatch.setattr(tables, "KEY_PARTS", 16)
    keys = {
        "even": [(i, 0) for i in range(200)],
        "uneven": [(int(1.25**i), i) for i in range(100)] + [(2**62 + i, i) for i in range(10)],
        "one value": [(5, i * i) for i in range(80)],
        "copies": [(5, i) for i in range(50)] + [(i, 0) for i in range(30)] + [(None, i) for i in range(9)],
    }[spread]
    df = spark.createDataFrame(keys, "k bigint, m int").repartition(3)
    order = sorted(keys, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for number in (1, 7, len(keys) // 7, len(keys)):
        found = [tuple(r) for r in page(df, ["k", "m"], number, 7).collect()]
        start = number * 7
        assert found == [(start + i, *r) for i, r in enumerate(order[start : start + 7])], number


def test_pages(stars):
    def shown(number):
        return [tuple(r) for r in page(stars, ["ra"], number, 12, ["ra"]).collect()]

    assert shown(0) == [(i, i * 12.0) for i in range(12)]
    assert shown(2) == [(i, i * 12.0) for i in range(24, 30)]
    assert shown(3) == []
    assert [r["ra"] for r in page_after(stars, "ra", 264.0, 3, ["ra"]).collect()] == [276.0, 288.0, 300.0]


# Specs ------------------------------------------------------------------------------------------

PROFILE = CatalogProfile()


def test_view_defaults():
    assert ViewSpec("histogram").with_defaults(PROFILE).bins == 20
    spec = ViewSpec("heatmap").with_defaults(PROFILE)
    assert (spec.x, spec.y, spec.color, spec.bins) == ("ra", "dec", "plx", 100)
    assert ViewSpec("targets").with_defaults(PROFILE).columns == (TARGET_ID, "gaia_dr3_source_id")
    assert ViewSpec("stats").with_defaults(PROFILE).columns == ("g_mag", "snr")
    with pytest.raises(FacetryError):
        ViewSpec("skyplot")


def test_view_fits_columns():
    spec = ViewSpec("scatter", x="gone", y="snr", color="gone", columns=("snr", "gone")).fitted(["ra", "dec", "snr"], PROFILE)
    assert (spec.x, spec.y, spec.color, spec.columns) == ("ra", "snr", "plx", ("snr",))


def test_view_swap_and_json():
    spec = ViewSpec("heatmap", x="a", y="b", log_x=True, flip_y=True, limits={"a": (0, 1)}, columns=("a",))
    turned = spec.swapped()
    assert (turned.x, turned.y, turned.log_y, turned.flip_x) == ("b", "a", True, True)
    assert turned.swapped() == spec
    assert ViewSpec.from_json(spec.to_json()) == spec


def test_requests(catalog):
    subset = SubsetSpec(dataset="aspcap", flags=())
    sizes = {
        kind: run_request(catalog, subset, ViewSpec(kind, bins=5)).count()
        for kind in ("histogram", "heatmap", "scatter", "stats", "targets")
    }
    assert sizes == {"histogram": 5, "heatmap": 5, "scatter": 10, "stats": 2, "targets": 10}
    views = CrossFilter()
    views.set("other", F.col("ra") > 100)
    shown = run_request(catalog, subset, ViewSpec("targets", columns=("ra",)), views, "me")
    assert {r["ra"] > 100 for r in shown.collect()} == {True}


def test_ranges_of_a_view(stars):
    found = {r["axis"]: (r["start"], r["end"]) for r in ViewSpec("heatmap", bins=3).ranges(stars, PROFILE).collect()}
    assert found["x"] == (0.0, 348.0) and found["y"] == pytest.approx((-90.0, 89.8))
    cells = ViewSpec("heatmap", bins=3).compile(stars, PROFILE).collect()
    assert found["color"] == (min(r["value"] for r in cells), max(r["value"] for r in cells))
    bars = {r["axis"]: (r["start"], r["end"]) for r in ViewSpec("histogram", x="same").ranges(stars, PROFILE).collect()}
    assert bars == {"x": (7.0, 7.0), "y": pytest.approx((0.0, 36.0))}
    points = ViewSpec("scatter", color="release", flip_x=True).ranges(stars, PROFILE).collect()
    assert {r["axis"]: r["start"] for r in points} == pytest.approx({"x": 365.4, "y": -98.99, "color": 0.0})
    with pytest.raises(FacetryError):
        ViewSpec("stats").ranges(stars, PROFILE)


def test_request_texts(catalog):
    params = {
        "plottype": "histogram",
        "x": "ra",
        "nbins": "5",
        "flipx": "True",
        "dataset": "spall",
        "expression": "ra.gt.1".replace(".gt.", " > ") + f".and.release.eq.'{SURVEY}'",
    }
    view = ViewSpec.from_params(params)
    assert (view.kind, view.bins, view.flip_x, view.log_x) == ("histogram", 5, True, False)
    found = run_params(catalog, params)
    expected = catalog.table.where(f"pipeline = 'spall' and ra > 1 and release = '{SURVEY}'").count()
    assert sum(r["n"] for r in found.collect()) == expected > 0
    with pytest.raises(FacetryError, match="names no view"):
        run_params(catalog, {"dataset": "spall"})
    with pytest.raises(FacetryError, match="unknown dataset"):
        run_params(catalog, {**params, "dataset": "sqall"})


def test_nothing_to_draw(stars):
    assert require_rows(stars) is stars
    with pytest.raises(EmptySubsetError):
        require_rows(stars.where("ra < 0"))
    cells = heatmap(stars, "ra", "dec", "logg", bins=2)
    assert require_values(cells) is cells
    with pytest.raises(EmptySubsetError):
        require_values(heatmap(stars.withColumn("none", F.lit(float("nan"))), "ra", "dec", "none", bins=2))


def test_describe_over_subset_with_view(catalog):
    found = run_request(catalog, SubsetSpec(dataset="spall"), ViewSpec("stats", columns=("snr",)))
    assert found.first()["count"] == 5
    assert run_request(catalog, SubsetSpec(dataset="spall"), ViewSpec("heatmap", statistic="count", bins=2)).count() > 0


@pytest.mark.parametrize("rows", [[("x", "missing"), ("y", None)], [("x", "r"), ("x", "s")], [("x", "A"), ("x", "a")]])
def test_a_pivot_never_has_two_columns_of_one_name(spark, rows):
    df = spark.createDataFrame(rows, "r string, c string")
    with pytest.raises(FacetryError):
        pivot_counts(df, "r", "c", missing=True)
