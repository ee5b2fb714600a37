"""All views of a dashboard in one scan, against each view by itself."""

import pytest

from facetry.errors import FacetryError
from facetry.functions.expressions import condition
from facetry.operators.binning import heatmap, histogram
from facetry.operators.crossfilter import CrossFilter
from facetry.operators.dashboard import BinnedView, all_views
from conftest import close

TEXTS = {"teff": "teff < 9000", "logg": "logg > 1", "snr": "snr >= 20", "control": "good == True"}


@pytest.fixture
def selections(stars):
    filters = CrossFilter()
    for key, text in TEXTS.items():
        filters.set(key, condition(stars, text))
    return filters


def rows_of(frame, y):
    return {(r["x_bin"], r["y_bin"] if y else None): r for r in frame.collect()}


@pytest.mark.parametrize("given", [True, False])
def test_each_view_as_by_itself(stars, selections, given):
    limits = {"teff": (3000, 10000), "logg": (0, 5), "snr": (0, 100), "ra": (0, 360)} if given else {}
    views = {
        "teff": BinnedView("teff", limits=limits),
        "logg": BinnedView("logg", value="snr", statistic="mean", bins=5, limits=limits),
        "snr": BinnedView("ra", "snr", "teff", "max", 4, limits),
        "other": BinnedView("ra", "logg", bins=3, limits=limits),
    }
    got = all_views(stars, selections, views).collect()
    for key, view in views.items():
        rows = selections.frame_for(stars, key)
        mine = {n: limits[n] for n in view.axes.values()} if given else None
        if view.y is None and view.value is None:
            expected = rows_of(histogram(rows, view.x, view.bins or 20, mine and mine[view.x]), False)
            value = "n"
        elif view.y is None:
            # A histogram of a statistic is a heat map with one row.
            same = heatmap(rows, view.x, "same", view.value, view.statistic, view.bins, mine and mine | {"same": (7, 7)})
            expected, value = {(b, None): r for (b, _), r in rows_of(same, True).items()}, "value"
        else:
            statistic = view.statistic
            expected, value = rows_of(heatmap(rows, view.x, view.y, view.value, statistic, view.bins, mine), True), "value"
        found = {(r["x_bin"], r["y_bin"]): r for r in got if r["view"] == key}
        assert set(found) == set(expected) and found
        for cell, row in expected.items():
            assert close(found[cell]["value"], None if row[value] is None else float(row[value]))
            assert close(found[cell]["x"], row["x"]) and (view.y is None or close(found[cell]["y"], row["y"]))


def test_categories_keep_their_place(stars, selections):
    selections.set("place", condition(stars, "telescope == 'lco25m'"))
    got = all_views(stars, selections, {"place": BinnedView("telescope"), "map": BinnedView("telescope", "release")}).collect()
    seen = selections.frame_for(stars, "place").groupBy("telescope").count().collect()
    assert {(r["x_label"], r["value"]) for r in got if r["view"] == "place"} == {(t, float(n)) for t, n in seen}
    assert {r["x_bin"] for r in got if r["view"] == "map"} <= {1} and all(r["x"] is None for r in got)


def test_one_scan_for_all_views(spark, sf):
    import __spark_entry__ as entry_points

    plan = entry_points.queries()["crossfilter_all_views"](spark, sf)
    parts = {"status"}  # the one categorical axis asks for its labels, by a subquery
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 1 + 2 * len(parts) or text.count("Relation [") <= 3


def test_no_selection_and_wrong_views(stars):
    got = all_views(stars, CrossFilter(), {"a": BinnedView("ra", bins=3)}).collect()
    assert sum(r["value"] for r in got) == 30
    with pytest.raises(FacetryError):
        BinnedView("ra", statistic="mode")
    with pytest.raises(FacetryError):
        BinnedView("ra", statistic="mean")
    with pytest.raises(FacetryError):
        BinnedView("ra", value="snr")
