"""The same binned statistic of several subsets, side by side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.functions.missing import is_categorical, present
from facetry.operators.binning import HEATMAP_BINS, MOST_CELLS, Limits, axes, clean_cell, grid
from facetry.operators.categories import CATEGORY_LIMIT
from facetry.operators.quantiles import grouped_median

REDUCERS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def compare_subsets(
    df: DataFrame,
    subsets: Mapping[str, Column | None],
    x: str,
    y: str,
    value: str | None = None,
    statistic: str = "count",
    bins: int = HEATMAP_BINS,
    limits: Mapping[str, Limits] | None = None,
    log: bool = False,
    closed: str = "both",
    dense: bool = False,
) -> DataFrame:
    """``(subset, x_bin, y_bin, x, y, value)`` on the common limits of ``df``.

    One scan serves all subsets: each is a conditional aggregate of the same cells, so a row is neither
    copied nor read again for the subsets it belongs to.  For medians the subset is part of the cell, and a
    row is counted once for each.  ``dense`` adds the cells of a subset that have no rows.
    """
    if statistic not in ("count", "median") and statistic not in REDUCERS:
        raise FacetryError(f"statistic is one of count, median, {', '.join(REDUCERS)}, not {statistic!r}")
    if statistic != "count" and value is None:
        raise FacetryError(f"the {statistic} of which column?")
    if value is not None and is_categorical(df, value):
        raise FacetryError(f"column {value!r} is categorical and has no {statistic}")
    found = axes(df, {"x": x, "y": y}, bins, limits, closed)
    members = {name: F.lit(True) if c is None else F.coalesce(c, F.lit(False)) for name, c in subsets.items()}
    placed = found.place(
        df,
        *([] if value is None else [present(df, value).alias("measured")]),
        *[c.alias(f"in{i}") for i, c in enumerate(members.values())],
    )
    long = _medians(placed, list(members), bins) if statistic == "median" else _reduced(placed, list(members), statistic)
    if dense:
        names = F.explode(F.array(*[F.lit(name) for name in members]))
        cells = grid(df, found).withColumn("subset", names)
        long = cells.join(long, ["subset", "x_bin", "y_bin"], "left")
    cleaned = long.withColumn("value", clean_cell(F.col("value"), log))
    return found.mark(cleaned).select("subset", "x_bin", "y_bin", "x", "y", "value")


def _medians(placed: DataFrame, members: list[str], bins: int) -> DataFrame:
    named = [F.when(F.col(f"in{i}"), F.lit(name)) for i, name in enumerate(members)]
    rows = placed.withColumn("subset", F.explode(F.array_compact(F.array(*named))))
    few = len(members) * max(bins, CATEGORY_LIMIT) ** 2 <= MOST_CELLS
    medians = grouped_median(rows, ["subset", "x_bin", "y_bin"], F.col("measured"), few_groups=few)
    return medians.withColumnRenamed("median", "value")


def _reduced(placed: DataFrame, members: list[str], statistic: str) -> DataFrame:
    parts = []
    for i in range(len(members)):
        parts.append(F.count_if(F.col(f"in{i}")).alias(f"n{i}"))
        if statistic != "count":
            parts.append(REDUCERS[statistic](F.when(F.col(f"in{i}"), F.col("measured"))).alias(f"v{i}"))
    cells = placed.groupBy("x_bin", "y_bin").agg(*parts)
    result = "n" if statistic == "count" else "v"
    rows = [
        F.struct(F.lit(name).alias("subset"), F.col(f"n{i}").alias("n"), F.col(f"{result}{i}").alias("value"))
        for i, name in enumerate(members)
    ]
    return cells.select("x_bin", "y_bin", F.inline(F.array(*rows))).where(F.col("n") > 0).drop("n")
