"""Missing values.

A float column of a catalogue marks a missing value by NaN or by NULL.  Spark orders NaN above every
number and lets it through sums and averages; here NaN is never greater than, less than or equal to
anything, and no statistic sees it.  Comparisons with NULL stay NULL, so that neither a condition nor
its inverse selects the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.errors import CatalogError

INFINITY = float("inf")


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise CatalogError(f"there is no column {name!r}")
    return df.schema[name].dataType


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_categorical(df: DataFrame, name: str) -> bool:
    """Text and boolean columns are categories; all others are numbers."""
    return isinstance(type_of(df, name), (T.StringType, T.BooleanType))


def is_missing(df: DataFrame, name: str) -> Column:
    c = column(name)
    return c.isNull() | F.isnan(c) if is_float(type_of(df, name)) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, or NULL where it is missing: what every statistic is computed from."""
    c = column(name)
    return F.when(~F.isnan(c), c) if is_float(type_of(df, name)) else c


def drawable(df: DataFrame, name: str) -> Column:
    """True where the value has a place on a numeric axis: not missing and not infinite."""
    c = column(name)
    if is_float(type_of(df, name)):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))
    return c.isNotNull()


def compare(left: Column, op: str, right: Column, left_float: bool, right_float: bool) -> Column:
    """``left op right`` where an operand that is NaN makes all but ``!=`` false.

    ``left_float`` and ``right_float`` say which operands can be NaN at all.
    """
    both_float = left_float and right_float
    if op == ">":
        return (left > right) & ~F.isnan(left) if left_float else left > right
    if op == ">=":
        return (left >= right) & ~F.isnan(left) if left_float else left >= right
    if op == "<":
        return (left < right) & ~F.isnan(right) if right_float else left < right
    if op == "<=":
        return (left <= right) & ~F.isnan(right) if right_float else left <= right
    if op == "==":
        return (left == right) & ~F.isnan(left) if both_float else left == right
    if op == "!=":
        return (left != right) | F.isnan(left) if both_float else left != right
    raise ValueError(f"unknown comparator {op!r}")
