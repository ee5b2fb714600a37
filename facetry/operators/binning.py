"""Histograms and heat maps: statistics of rows grouped by bins of one or two columns.

A numeric axis is cut into equal bins between its limits; the smallest and largest value are found by
a scalar subquery unless the caller gives them, so that one action gives the result.  A categorical
axis has one bin per value.  Rows without a place on an axis are left out.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.functions.missing import INFINITY, column, drawable, is_categorical, present
from facetry.operators.categories import CATEGORY_LIMIT, code_of, sorted_labels
from facetry.operators.quantiles import approximate_median, grouped_median

# Defaults and ranges of the two binned views.
HISTOGRAM_BINS = 20
HEATMAP_BINS = 100
MOST_CELLS = 240 * 240
STATISTICS = ("count", "mean", "median", "sum", "min", "max")

Limits = tuple[float | Column, float | Column]


def _ends(df: DataFrame, names: list[str]) -> Column:
    """Lowest and highest drawable value of each column, found in one pass, as one scalar subquery."""
    parts = []
    for i, name in enumerate(names):
        value = F.when(drawable(df, name), column(name)).cast("double")
        parts += [F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}")]
    return df.agg(F.struct(*parts).alias("ends")).scalar()


def limits_of(df: DataFrame, names: list[str]) -> dict[str, Limits]:
    """Lowest and highest value of each numeric column."""
    ends = _ends(df, names)
    return {name: (ends[f"low{i}"], ends[f"high{i}"]) for i, name in enumerate(names)}


def _double(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def bin_number(value: Column, limits: Limits, bins: int, closed: str = "both") -> Column:
    """The bin of a value that lies between the limits, from 0.

    ``closed="both"`` puts the upper limit into the last bin; with ``"left"`` the caller leaves it out.
    When all values are equal they are in bin 0.
    """
    low, high = map(_double, limits)
    place = F.floor((value.cast("double") - low) / F.nullif(high - low, F.lit(0.0)) * bins)
    if closed == "both":
        place = F.when(place < bins, place).when(place.isNotNull(), F.lit(bins - 1))
    return F.coalesce(place, F.lit(0)).cast("int")


def bin_edge(number: Column, limits: Limits, bins: int) -> Column:
    low, high = map(_double, limits)
    return low + number * (high - low) / bins


def bin_center(number: Column, limits: Limits, bins: int) -> Column:
    return bin_edge(number + 0.5, limits, bins)


@dataclass(frozen=True)
class Axis:
    """One binned axis: which rows it holds, their bin, how many bins, and what a bin stands for."""

    rows: Column
    bin: Column
    bins: Column | int
    mark: Column
    width: Column


@dataclass(frozen=True)
class Axes:
    """The axes of a view by role, and the limits that had to be computed for them.

    Expressions of an axis read the limits from the column ``ENDS``, which ``attach`` adds, so that the
    subquery stands once in each step of the plan however often its result is used.
    """

    by_role: dict[str, Axis]
    ends: Column | None

    ENDS = "_ends"

    def __getitem__(self, role: str) -> Axis:
        return self.by_role[role]

    def attach(self, df: DataFrame) -> DataFrame:
        return df if self.ends is None else df.withColumn(self.ENDS, self.ends)

    def place(self, df: DataFrame, *carried: Column) -> DataFrame:
        """The bins of the rows that have a place on every axis, with the carried columns."""
        placed = self.attach(df)
        for axis in self.by_role.values():
            placed = placed.where(axis.rows)
        bins = [axis.bin.alias(f"{role}_bin") for role, axis in self.by_role.items()]
        return placed.select(*bins, *carried)

    def mark(self, cells: DataFrame) -> DataFrame:
        """Cells with the centre or the category of their bins, as a column named by the role."""
        marks = {role: axis.mark for role, axis in self.by_role.items()}
        return self.attach(cells).withColumns(marks).drop(self.ENDS)


def axes(
    df: DataFrame,
    names: Mapping[str, str],
    bins: int,
    limits: Mapping[str, Limits] | None = None,
    closed: str = "both",
    category_limit: int = CATEGORY_LIMIT,
) -> Axes:
    """The axes of a view; ``names`` maps a role such as ``x`` to a column."""
    if bins < 1:
        raise FacetryError("at least one bin is needed")
    if closed not in ("both", "left"):
        raise FacetryError(f"closed is 'both' or 'left', not {closed!r}")
    given = dict(limits or {})
    numeric = dict.fromkeys(n for n in names.values() if not is_categorical(df, n))
    sought = [n for n in numeric if n not in given]
    shared = F.col(Axes.ENDS)
    ends = {n: (shared[f"low{i}"], shared[f"high{i}"]) for i, n in enumerate(sought)}
    result = {}
    for role, name in names.items():
        number = F.col(f"{role}_bin")
        if name in numeric:
            low, high = map(_double, given[name] if name in given else ends[name])
            value = column(name)
            rows = drawable(df, name)
            if name in given:
                rows = rows & (value >= low) & (value <= high)
            if closed == "left":
                rows = rows & (value < high)
            result[role] = Axis(
                rows,
                bin_number(value, (low, high), bins, closed),
                bins,
                bin_center(number, (low, high), bins),
                (high - low) / bins,
            )
        else:
            labels = sorted_labels(df, name, category_limit)
            result[role] = Axis(
                column(name).isNotNull(),
                code_of(labels, column(name)),
                F.size(labels),
                F.get(labels, number),
                F.lit(1.0),
            )
    return Axes(result, _ends(df, sought) if sought else None)


def grid(df: DataFrame, found: Axes) -> DataFrame:
    """Every combination of bins, counted through without a join."""
    sizes = [F.lit(a.bins) if isinstance(a.bins, int) else a.bins for a in found.by_role.values()]
    cells = sizes[0]
    for size in sizes[1:]:
        cells = cells * size
    # sequence() counts down from 0 to -1 when there is no category at all: no cell then.
    numbers = F.when(cells > 0, F.sequence(F.lit(0), (cells - 1).cast("int")))
    one = df.sparkSession.range(1).select(F.explode(numbers).alias("cell"))
    below = F.lit(1)
    columns = []
    for role, size in reversed(list(zip(found.by_role, sizes))):
        number = F.floor(F.col("cell") / below).cast("int") % size
        columns.append(number.cast("int").alias(f"{role}_bin"))
        below = below * size
    return one.select(*reversed(columns))


def histogram(
    df: DataFrame,
    x: str,
    bins: int = HISTOGRAM_BINS,
    limits: Limits | None = None,
    closed: str = "both",
    dense: bool = False,
    category_limit: int = CATEGORY_LIMIT,
) -> DataFrame:
    """Counts per bin: ``(x_bin, x, n)``; ``x`` is the bin's centre or its category.

    ``dense`` adds the empty bins with count 0.
    """
    found = axes(df, {"x": x}, bins, {x: limits} if limits else None, closed, category_limit)
    counts = found.place(df).groupBy("x_bin").agg(F.count("*").alias("n"))
    if dense:
        counts = grid(df, found).join(counts, "x_bin", "left").fillna(0, subset=["n"])
    return found.mark(counts).select("x_bin", "x", "n")


def _category_numbers(df: DataFrame, x: str, bins_more: int) -> DataFrame:
    last = F.size(sorted_labels(df, x)) - 1 + bins_more
    numbers = F.when(last >= 0, F.sequence(F.lit(0), last))
    return df.sparkSession.range(1).select(F.explode(numbers).alias("i"))


def histogram_edges(df: DataFrame, x: str, bins: int = HISTOGRAM_BINS, limits: Limits | None = None) -> DataFrame:
    """The edges of the bins of an axis, one more than bins; half a step around a category's number."""
    if is_categorical(df, x):
        return _category_numbers(df, x, 1).select("i", (F.col("i") - 0.5).cast("double").alias("edge"))
    found = limits or limits_of(df, [x])[x]
    numbers = df.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("i"))
    return numbers.select("i", bin_edge(F.col("i"), found, bins).alias("edge"))


def histogram_centers(df: DataFrame, x: str, bins: int = HISTOGRAM_BINS, limits: Limits | None = None) -> DataFrame:
    """The centres of the bins of an axis; the number of a category."""
    if is_categorical(df, x):
        return _category_numbers(df, x, 0).select("i", F.col("i").cast("double").alias("center"))
    found = limits or limits_of(df, [x])[x]
    numbers = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("i"))
    return numbers.select("i", bin_center(F.col("i"), found, bins).alias("center"))


def heatmap(
    df: DataFrame,
    x: str,
    y: str,
    value: str | None = None,
    statistic: str = "mean",
    bins: int = HEATMAP_BINS,
    limits: Mapping[str, Limits] | None = None,
    closed: str = "both",
    dense: bool = False,
    log: bool = False,
    approximate: bool = False,
    category_limit: int = CATEGORY_LIMIT,
) -> DataFrame:
    """A statistic per cell: ``(x_bin, y_bin, x, y, value)``, empty cells only when ``dense``.

    ``approximate`` takes the middle of a narrow range that holds the median, which saves one pass.  An infinite result is missing;
    ``log`` takes the logarithm of the result, missing where there is none.
    """
    if statistic not in STATISTICS:
        raise FacetryError(f"statistic is one of {', '.join(STATISTICS)}, not {statistic!r}")
    if statistic != "count" and value is None:
        raise FacetryError(f"the {statistic} of which column?")
    if value is not None and is_categorical(df, value):
        raise FacetryError(f"column {value!r} is categorical and has no {statistic}")
    found = axes(df, {"x": x, "y": y}, bins, limits, closed, category_limit)
    keys = ["x_bin", "y_bin"]
    measured = F.lit(1) if value is None else present(df, value)
    placed = found.place(df, measured.alias("measured"))
    if statistic == "median":
        few = max(bins, category_limit) ** 2 <= MOST_CELLS
        median = approximate_median if approximate else grouped_median
        medians = median(placed, keys, F.col("measured"), few_groups=few)
        cells = medians.withColumnRenamed("median", "value")
    else:
        cells = placed.groupBy(*keys).agg(_statistic(statistic, F.col("measured")).alias("value"))
    cells = cells.withColumn("value", clean_cell(F.col("value"), log))
    if dense:
        cells = grid(df, found).join(cells, keys, "left")
    return found.mark(cells).select(*keys, "x", "y", "value")


def _statistic(name: str, value: Column) -> Column:
    if name == "count":
        return F.count("*")
    return {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[name](value)


def clean_cell(value: Column, log: bool = False) -> Column:
    finite = F.when(F.abs(value) < F.lit(INFINITY), value)
    return F.log10(finite) if log else finite


def cell_widths(df: DataFrame, x: str, y: str, bins: int = HEATMAP_BINS) -> DataFrame:
    """Width of a cell on both axes; a category is 1 wide."""
    found = axes(df, {"x": x, "y": y}, bins)
    one = found.attach(df.sparkSession.range(1))
    return one.select(found["x"].width.alias("x_width"), found["y"].width.alias("y_width"))
