"""All binned views of a dashboard in one scan.

Each view sees the selections of all others.  A row notes once, as bits, which selections it fails; it belongs to the
views whose own bits are all that is set.  Rows that fail two selections of different views belong to none and go no
further; the others are counted for each of their views in one aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.functions.missing import column, drawable, is_categorical, present
from facetry.operators.binning import HEATMAP_BINS, HISTOGRAM_BINS, Axes, Limits, axes, clean_cell
from facetry.operators.crossfilter import CrossFilter

STATISTICS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
MOST_SELECTIONS = 63
ENDS = "_dashboard_ends"


@dataclass(frozen=True)
class BinnedView:
    """A histogram, or with ``y`` a heat map, of counts or of a statistic of ``value``."""

    x: str
    y: str | None = None
    value: str | None = None
    statistic: str = "count"
    bins: int | None = None
    limits: Mapping[str, Limits] | None = None

    def __post_init__(self) -> None:
        if self.statistic != "count" and self.statistic not in STATISTICS:
            raise FacetryError(f"statistic is one of count, {', '.join(STATISTICS)}, not {self.statistic!r}")
        if (self.statistic == "count") != (self.value is None):
            raise FacetryError("a value belongs to each statistic but the count")

    @property
    def axes(self) -> dict[str, str]:
        return {"x": self.x} if self.y is None else {"x": self.x, "y": self.y}


def failed_selections(filters: CrossFilter) -> Column:
    """A bit for each selection that a row does not meet, by the order of ``filters.keys``."""
    if len(filters.keys) > MOST_SELECTIONS:
        raise FacetryError(f"at most {MOST_SELECTIONS} selections at once")
    bits = F.lit(0).cast("bigint")
    for i, key in enumerate(filters.keys):
        met = F.coalesce(filters.condition_of(key), F.lit(False))
        bits = bits.bitwiseOR(F.when(met, F.lit(0)).otherwise(F.lit(1 << i)).cast("bigint"))
    return bits


def _seen_by(filters: CrossFilter, view: str) -> Column:
    own = 1 << filters.keys.index(view) if view in filters.keys else 0
    return F.col("_failed").bitwiseAND(F.lit(~own)) == 0


def all_views(df: DataFrame, filters: CrossFilter, views: Mapping[str, BinnedView]) -> DataFrame:
    """``(view, x_bin, y_bin, x, y, x_label, y_label, value)``: the filled bins of every view.

    ``x`` and ``y`` are centres of numeric bins, the labels are categories; ``y`` is empty for a histogram. A numeric axis
    without given limits runs over the rows that its view sees; those limits are found for all views in one pass more.
    Categories are numbered over all rows of ``df``, so that they keep their place under any selection.
    """
    marked = df.withColumn("_failed", failed_selections(filters))
    possible = F.lit(False)
    for view in views:
        possible = possible | _seen_by(filters, view)
    marked = marked.where(possible)
    found, ends = _limits(marked, filters, views)
    if ends is not None:
        marked = marked.withColumn(ENDS, ends)
    placed = {key: axes(df, view.axes, _bins(view), found[key]) for key, view in views.items()}
    cells = [_cell(df, key, view, placed[key], _seen_by(filters, key)) for key, view in views.items()]
    # Inside one row: nothing but the bins of its views goes on.
    rows = marked.select(F.inline(F.array_compact(F.array(*cells))))
    counts = rows.groupBy("view", "x_bin", "y_bin").agg(
        F.count("*").alias("n"), *[f("measured").alias(name) for name, f in STATISTICS.items()]
    )
    if ends is not None:
        counts = counts.withColumn(ENDS, ends)
    return counts.select("view", "x_bin", "y_bin", *_marks(df, views, placed), _values(views).alias("value"))


def _bins(view: BinnedView) -> int:
    return view.bins or (HISTOGRAM_BINS if view.y is None else HEATMAP_BINS)


def _limits(
    marked: DataFrame, filters: CrossFilter, views: Mapping[str, BinnedView]
) -> tuple[dict[str, dict[str, Limits]], Column | None]:
    """The limits of every numeric axis, and the subquery that those which are not given are read from."""
    found: dict[str, dict[str, Limits]] = {}
    parts = []
    for i, (key, view) in enumerate(views.items()):
        found[key] = dict(view.limits or {})
        for role, name in view.axes.items():
            if name in found[key] or is_categorical(marked, name):
                continue
            value = F.when(_seen_by(filters, key) & drawable(marked, name), column(name)).cast("double")
            parts += [F.min(value).alias(f"low_{role}{i}"), F.max(value).alias(f"high_{role}{i}")]
            found[key][name] = (F.col(ENDS)[f"low_{role}{i}"], F.col(ENDS)[f"high_{role}{i}"])
    return found, marked.agg(F.struct(*parts).alias("ends")).scalar() if parts else None


def _cell(df: DataFrame, key: str, view: BinnedView, placed: Axes, seen: Column) -> Column:
    """The bins of a row in a view, or NULL where it has none."""
    inside = seen
    for axis in placed.by_role.values():
        inside = inside & F.coalesce(axis.rows, F.lit(False))
    measured = F.lit(None) if view.value is None else present(df, view.value)
    cell = F.struct(
        F.lit(key).alias("view"),
        placed["x"].bin.cast("int").alias("x_bin"),
        (F.lit(None) if view.y is None else placed["y"].bin).cast("int").alias("y_bin"),
        measured.cast("double").alias("measured"),
    )
    return F.when(inside, cell)


def _marks(df: DataFrame, views: Mapping[str, BinnedView], placed: Mapping[str, Axes]) -> list[Column]:
    columns = []
    for suffix, kind, categorical in (("", "double", False), ("_label", "string", True)):
        for role in ("x", "y"):
            mark = F.lit(None)
            for key, view in views.items():
                if role in view.axes and is_categorical(df, view.axes[role]) == categorical:
                    mark = F.when(F.col("view") == key, placed[key][role].mark.cast(kind)).otherwise(mark)
            columns.append(mark.cast(kind).alias(role + suffix))
    return columns


def _values(views: Mapping[str, BinnedView]) -> Column:
    value = F.col("n").cast("double")
    for key, view in views.items():
        if view.statistic != "count":
            value = F.when(F.col("view") == key, clean_cell(F.col(view.statistic))).otherwise(value)
    return value
