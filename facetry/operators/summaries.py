"""Counts and statistics of a subset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.errors import EmptySubsetError, FacetryError
from facetry.functions.missing import column, is_categorical, is_missing, present, type_of
from facetry.operators.categories import CATEGORY_LIMIT


def subset_count(df: DataFrame, condition: Column | None = None) -> DataFrame:
    rows = df if condition is None else df.where(condition)
    return rows.agg(F.count("*").alias("n"))


def require_rows(df: DataFrame) -> DataFrame:
    """``df`` itself; no rows is an error.  Reads no more than the first row."""
    if df.isEmpty():
        raise EmptySubsetError("the subset has no rows")
    return df


def require_values(cells: DataFrame, name: str = "value") -> DataFrame:
    """The cells of a view; when all of them are missing there is nothing to draw, which is an error."""
    if cells.where(column(name).isNotNull()).isEmpty():
        raise EmptySubsetError("all values of the view are missing")
    return cells


def subset_progress(df: DataFrame, condition: Column) -> DataFrame:
    """Filtered rows, all rows and the share in percent, in one pass."""
    counts = df.agg(F.count_if(condition).alias("filtered"), F.count("*").alias("total"))
    share = F.col("filtered") / F.greatest(F.col("total"), F.lit(1)) * 100
    return counts.withColumn("percent", share)


def minmax(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.min(present(df, name)).alias("low"), F.max(present(df, name)).alias("high"))


def distinct_count(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(present(df, name)).alias("n_distinct"))


def unique_values(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """The distinct values; with a limit the first ones in sorted order."""
    values = df.select(column(name)).distinct()
    return values if limit is None else values.orderBy(column(name)).limit(limit)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """``(value, n)``, most frequent value first."""
    counts = df.groupBy(column(name).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value")


def describe(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per numeric column: type, count, missing, mean, population deviation, smallest, largest.

    All columns are read in one pass; text columns are left out.
    """
    names = [n for n in names if not is_categorical(df, n)]
    if not names:
        raise FacetryError("no numeric column to describe")
    parts, rows = [], []
    for i, name in enumerate(names):
        value = present(df, name).cast("double")
        parts += [
            F.count(value).alias(f"count{i}"),
            F.count_if(is_missing(df, name)).alias(f"na{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.stddev_pop(value).alias(f"std{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(type_of(df, name).simpleString()).alias("data_type"),
                *[F.col(f"{s}{i}").alias(s) for s in ("count", "na", "mean", "std", "min", "max")],
            )
        )
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def pivot_counts(
    df: DataFrame,
    rows: str,
    columns: str,
    values: Sequence[str] | None = None,
    limit: int = CATEGORY_LIMIT,
    missing: bool = False,
) -> DataFrame:
    """Counts of two categorical columns as a table with one column per value of ``columns``.

    The values, fewer than ``limit``, are read first unless they are given.  ``missing`` adds a column
    of that name, which counts the rows without a value in ``columns``; rows without one in ``rows`` have a line of
    their own.
    """
    if values is None:
        found = df.select(column(columns)).where(column(columns).isNotNull()).distinct().limit(limit).collect()
        if len(found) >= limit:
            raise FacetryError(f"column {columns!r} has {limit} or more categories")
        values = sorted(r[0] for r in found)
    label = column(columns)
    counts = [F.count_if(label == F.lit(v)).alias(str(v)) for v in values]
    counts += [F.count_if(label.isNull()).alias("missing")] if missing else []
    names = [n.lower() for n in [rows, *map(str, values), *(["missing"] if missing else [])]]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise FacetryError(f"two columns of the table would be called {', '.join(map(repr, doubled))}")
    return df.groupBy(column(rows)).agg(*counts)
