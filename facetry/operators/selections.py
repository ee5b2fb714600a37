"""Selections made in a view, as conditions for the other views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.functions.missing import column, compare, is_categorical, is_float, type_of
from facetry.operators.binning import Limits, bin_center, bin_edge

BAR_MODES = ("edges", "centers")
POINT_MODES = ("pairs", "independent")


def _compare(df: DataFrame, name: str, op: str, value: Column) -> Column:
    return compare(column(name), op, value, is_float(type_of(df, name)), False)


def select_bars(
    df: DataFrame, name: str, limits: Limits, bins: int, selected: Sequence[int], mode: str = "edges"
) -> Column:
    """Rows in the bars from the first to the last selected one of a numeric axis.

    ``mode="centers"`` is the older rule, which runs from centre to centre and so loses the outer half
    of the two outer bars.
    """
    if mode not in BAR_MODES:
        raise FacetryError(f"mode is one of {', '.join(BAR_MODES)}, not {mode!r}")
    first, last = min(selected), max(selected)
    if mode == "centers":
        low = bin_center(F.lit(first), limits, bins)
        high = bin_center(F.lit(last), limits, bins)
        return _compare(df, name, ">=", low) & _compare(df, name, "<=", high)
    upper = "<=" if last == bins - 1 else "<"
    return _compare(df, name, ">=", bin_edge(F.lit(first), limits, bins)) & _compare(
        df, name, upper, bin_edge(F.lit(last + 1), limits, bins)
    )


def select_categories(name: str, labels: Sequence[str | bool]) -> Column:
    return column(name).isin(list(labels))


def select_cells(df: DataFrame, x: Column, y: Column) -> Column:
    """A box of a heat map: the condition on its x axis and the one on its y axis."""
    return x & y


def select_points(df: DataFrame, x: str, y: str, points: DataFrame, mode: str = "pairs") -> Column:
    """Rows at one of the selected points ``(x, y)``.

    ``mode="independent"`` is the older rule: x is among the x values and y among the y values, which
    also finds pairs that nobody selected.
    """
    if mode not in POINT_MODES:
        raise FacetryError(f"mode is one of {', '.join(POINT_MODES)}, not {mode!r}")
    for side in ("x", "y"):
        points = points.where(F.col(side).isNotNull())
        if is_float(points.schema[side].dataType):
            points = points.where(~F.isnan(side))
    if mode == "independent":
        return column(x).isin(points.select("x")) & column(y).isin(points.select("y"))
    return F.struct(column(x), column(y)).isin(points.select("x", "y"))


def viewport(
    df: DataFrame,
    x: str | None = None,
    x_range: tuple[float, float] | None = None,
    y: str | None = None,
    y_range: tuple[float, float] | None = None,
) -> Column | None:
    """Rows strictly inside the visible part of a view; an axis without a range does not restrict."""
    parts = []
    for name, ends in ((x, x_range), (y, y_range)):
        if name is not None and ends is not None and not is_categorical(df, name):
            parts.append(_compare(df, name, ">", F.lit(float(min(ends)))))
            parts.append(_compare(df, name, "<", F.lit(float(max(ends)))))
    return reduce(and_, parts) if parts else None
