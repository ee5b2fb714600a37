"""Ranges of axes and colour bars, as one-row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.missing import column, is_categorical, present
from facetry.operators.categories import CATEGORY_LIMIT, sorted_labels

# Padding of an axis, as a share of its span or in categories.
SPAN_SHARE = 20
HISTOGRAM_CATEGORY_PAD = 1.2
HEATMAP_CATEGORY_PAD = 0.5


def log_values(df: DataFrame, name: str) -> Column:
    """The logarithm where there is one; NULL for missing, zero and negative values."""
    return F.log10(present(df, name).cast("double"))


def _category_ends(df: DataFrame, name: str, limit: int) -> DataFrame:
    last = F.size(sorted_labels(df, name, limit)) - 1
    return df.sparkSession.range(1).select(F.lit(0.0).alias("low"), last.cast("double").alias("high"))


def _number_ends(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))


def positive_range(df: DataFrame, name: str) -> DataFrame:
    """Smallest and largest of the values that have a place on a logarithmic axis."""
    return _number_ends(df.where(column(name) > 0), present(df, name))


def axis_range(
    df: DataFrame,
    name: str,
    plot: str = "scatter",
    log: bool = False,
    flip: bool = False,
    category_limit: int = CATEGORY_LIMIT,
) -> DataFrame:
    """``(start, end)`` of an axis with its padding; on a logarithmic axis padded in the exponent."""
    categorical = is_categorical(df, name)
    log = log and not categorical
    if categorical:
        ends = _category_ends(df, name, category_limit)
    else:
        ends = _number_ends(df, log_values(df, name) if log else present(df, name))
    if plot == "histogram" and categorical:
        pad = F.lit(HISTOGRAM_CATEGORY_PAD)
    elif plot == "heatmap":
        pad = F.lit(HEATMAP_CATEGORY_PAD if categorical else 0.0)
    else:
        pad = (F.col("high") - F.col("low")) / SPAN_SHARE
    start, end = F.col("low") - pad, F.col("high") + pad
    if log:
        start, end = F.pow(F.lit(10.0), start), F.pow(F.lit(10.0), end)
    if flip:
        start, end = end, start
    return ends.select(start.alias("start"), end.alias("end"))


def heatmap_color_range(cells: DataFrame, statistic: str, log: bool = False) -> DataFrame:
    """``(low, high)`` of the cells; plain counts start at 0."""
    ends = cells.agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))
    return ends.withColumn("low", F.lit(0.0)) if statistic == "count" and not log else ends


def scatter_color_range(
    df: DataFrame, name: str, log: bool = False, category_limit: int = CATEGORY_LIMIT
) -> DataFrame:
    """``(low, high)`` of the rows; of the category numbers for a categorical colour."""
    if is_categorical(df, name):
        return _category_ends(df, name, category_limit)
    return _number_ends(df, log_values(df, name) if log else present(df, name))


def count_axis_range(counts: DataFrame, log: bool = False) -> DataFrame:
    """``(start, end)`` of the count axis of a histogram."""
    return counts.agg(F.lit(1.0 if log else 0.0).alias("start"), (F.max("n") * 1.2).alias("end"))
