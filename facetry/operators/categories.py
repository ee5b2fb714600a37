"""Categories: text and boolean columns with few values, numbered in sorted order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.functions.missing import column, is_categorical

# Fixed value: a column is drawn as categories while it has fewer distinct values than this.
CATEGORY_LIMIT = 10


def sorted_labels(df: DataFrame, name: str, limit: int = CATEGORY_LIMIT) -> Column:
    """The sorted distinct values as one array, computed once as a scalar subquery.

    At most ``limit`` values leave the distinct step, which is enough to know that there are too many;
    reading the array then ends the job with an error instead of gathering an unbounded column.
    """
    if not is_categorical(df, name):
        raise FacetryError(f"column {name!r} is not categorical")
    values = df.select(column(name).alias("label")).where(F.col("label").isNotNull()).distinct().limit(limit)
    labels = values.agg(F.array_sort(F.collect_list("label")).alias("labels"))
    message = f"column {name!r} has {limit} or more categories"
    return labels.select(
        F.when(F.size("labels") < limit, F.col("labels")).otherwise(
            F.raise_error(F.lit(message)).cast(labels.schema["labels"].dataType)
        )
    ).scalar()


def code_of(labels: Column, value: Column) -> Column:
    """The number of a value among the sorted labels, from 0."""
    return (F.array_position(labels, value) - 1).cast("int")


def with_codes(df: DataFrame, name: str, code: str = "code", limit: int = CATEGORY_LIMIT) -> DataFrame:
    """``df`` with the number of each row's category."""
    return df.withColumn(code, code_of(sorted_labels(df, name, limit), column(name)))


def category_codes(df: DataFrame, name: str, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """The dictionary of a column: ``(label, code)``."""
    one = df.sparkSession.range(1).select(F.posexplode(sorted_labels(df, name, limit)).alias("code", "label"))
    return one.select("label", "code")


def category_guard(df: DataFrame, names: list[str], limit: int = CATEGORY_LIMIT) -> DataFrame:
    """``(column, n_distinct, allowed)`` for each column, in one pass."""
    counts = df.agg(*[F.count_distinct(column(n)).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), column(n).alias("n_distinct")) for n in names])
    return counts.select(F.inline(rows)).withColumn("allowed", F.col("n_distinct") < limit)
