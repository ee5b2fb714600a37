"""Exact medians of groups of any size.

Spark's ``median`` keeps every value of a group in the memory of one task.  Here a KLL sketch of each group, merged
on the way to the shuffle, gives two values that lie ``MARGIN`` rank errors below and above the median.  That error is
a share of the group's size and the same for every distribution.  A sketch holds a group of up to ``SKETCH`` values
whole, so the median of such a group is in it.  For the others the distinct values between the two are counted and
ranked, less than one in a hundred, with the number of values below them; groups of more than ``LARGE`` values are
narrowed by a second sketch of what lies between first.  Which step gives a group's median depends on its size alone,
and each step counts for itself, so a task that runs again with another sketch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH = 2048
#: Rank error of a sketch of this size, with 99 % confidence; three of them are exceeded once in 1e13 groups.
RANK_ERROR = 2.296 / SKETCH**0.9723
MARGIN = 3 * RANK_ERROR
#: Half the share of one value in a group that a sketch holds whole.
HALF_A_VALUE = 0.25 / SKETCH
#: Shares at which the sketch of a narrowed group is read.
GRID = 256
LARGE = 100_000_000
SALTS = 32
BELOW, INSIDE, ABOVE = 0, 1, 2


def _ranks(size: Column) -> tuple[Column, Column]:
    """The ranks, from 1, whose values have the median in their middle."""
    return F.floor((size - 1) / 2) + 1, F.floor(size / 2) + 1


def _values_at(sketch: str, shares: list[float]) -> Column:
    """The values at some shares of a group. Shares are constants, so that one call finds them all."""
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.array(*[F.lit(s) for s in shares]))


def _sketched(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(
        F.kll_sketch_agg_double("v", SKETCH).alias("sketch"),
        F.count("v").alias("size"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
    ).withColumn("at", _values_at("sketch", [0.5, 0.5 + HALF_A_VALUE, 0.5 - MARGIN, 0.5 + MARGIN]))


def _middle() -> Column:
    """The median of a group that its sketch holds whole: one value, or the middle of two."""
    return (F.col("at")[0] + F.col("at")[1]) / 2


def _with_ranges(values: DataFrame, ranges: DataFrame, keys: list[str], few_groups: bool) -> DataFrame:
    """The values with the range of their group, and how they lie to it."""
    if few_groups:
        joined = values.join(F.broadcast(ranges), keys)
    else:
        salted = values.withColumn("salt", F.spark_partition_id() % SALTS)
        copies = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, [*keys, "salt"])
    zone = F.when(F.col("v") < F.col("low"), BELOW).when(F.col("v") > F.col("high"), ABOVE).otherwise(INSIDE)
    return joined.withColumn("zone", zone)


def _narrowed(values: DataFrame, ranges: DataFrame, keys: list[str], few_groups: bool) -> DataFrame:
    """Ranges of large groups, from a sketch of what lies inside the given ones."""
    inside = F.col("zone") == INSIDE
    counted = (
        _with_ranges(values, ranges, keys, few_groups)
        .groupBy(*keys, "size", "low", "high")
        .agg(
            F.kll_sketch_agg_double(F.when(inside, F.col("v")), SKETCH).alias("sketch"),
            F.count_if(inside).alias("held"),
            F.count_if(F.col("zone") == BELOW).alias("below"),
        )
    )
    held, below = F.col("held"), F.col("below")
    low_rank, high_rank = (rank - below for rank in _ranks(F.col("size")))
    grid = _values_at("sketch", [i / GRID for i in range(GRID + 1)])
    first = F.greatest(F.floor((low_rank / held - MARGIN) * GRID), F.lit(0)).cast("int")
    last = F.least(F.ceil((high_rank / held + MARGIN) * GRID), F.lit(GRID)).cast("int")
    low, high = F.get(grid, first), F.get(grid, last)
    # A median outside the first range is found beyond the end it has passed.
    return counted.select(
        *keys,
        "size",
        F.when(low_rank < 1, F.lit(float("-inf"))).when(high_rank > held, F.col("low")).otherwise(low).alias("low"),
        F.when(high_rank > held, F.lit(float("inf"))).when(low_rank < 1, F.col("high")).otherwise(high).alias("high"),
    )


def _ranked(values: DataFrame, ranges: DataFrame, keys: list[str], few_groups: bool) -> DataFrame:
    """``keys`` and ``median`` of the groups of ``ranges``, by the ranks of the distinct values inside."""
    value = F.when(F.col("zone") == INSIDE, F.col("v"))
    counted = (
        _with_ranges(values, ranges, keys, few_groups)
        .groupBy(*keys, "size", "zone", value.alias("v"))
        .agg(F.count("*").alias("copies"))
    )
    in_order = Window.partitionBy(*keys).orderBy("zone", "v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("copies").over(in_order))
    lower, upper = (
        F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("copies") < rank), F.col("v")))
        for rank in _ranks(F.col("size"))
    )
    missed = F.raise_error(F.lit("a median lies outside its range")).cast("double")
    return ranked.groupBy(*keys).agg(F.coalesce((lower + upper) / 2, missed).alias("median"))


def _may_have(values: DataFrame, rows: int) -> bool:
    """Whether there may be so many rows, by the bytes that the optimiser expects. A step that is left out costs time only."""
    size = values._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) >= rows


def approximate_median(rows: DataFrame, keys: Sequence[str], value: Column, few_groups: bool = False) -> DataFrame:
    """``keys`` and ``median``: a value whose rank is within ``RANK_ERROR`` of the median's, in one pass."""
    values = rows.select(*keys, value.cast("double").alias("v")).where(F.col("v").isNotNull())
    return _sketched(values, list(keys)).select(*keys, _middle().alias("median"))


def grouped_median(rows: DataFrame, keys: Sequence[str], value: Column, few_groups: bool = False) -> DataFrame:
    """``keys`` and ``median`` of the values that are not NULL.

    ``few_groups`` says that the caller has bounded the number of groups, so that the ranges fit into
    a broadcast; otherwise each range is copied for a number of salts, and the rows of a hot group are
    spread over them.
    """
    keys = list(keys)
    values = rows.select(*keys, value.cast("double").alias("v")).where(F.col("v").isNotNull())
    size = F.col("size")
    sketched = _sketched(values, keys)
    whole = (size <= SKETCH) | (F.col("least") == F.col("most"))
    held = sketched.where(whole).select(*keys, _middle().alias("median"))
    ranges = sketched.where(~whole).select(*keys, "size", F.col("at")[2].alias("low"), F.col("at")[3].alias("high"))
    if _may_have(values, LARGE):
        narrow = _narrowed(values, ranges.where(size > LARGE), keys, few_groups)
        ranges = ranges.where(size <= LARGE).unionByName(narrow)
    return held.unionByName(_ranked(values, ranges, keys, few_groups))
