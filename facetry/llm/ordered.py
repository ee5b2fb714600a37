"""Running totals in the order of a key, where one group may hold most of the rows.

A window over a group runs in one task. Here rows are dealt into *blocks*, which are ranges of (group, order), and
each block makes its own running totals. Only the first and the last group of a block can go on in another block, so
at most two totals per block are carried on: the carried table is bounded by twice the number of blocks, whatever the
groups are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.components import stored

#: For each kind of total: its aggregate, and how a block's total meets what is carried from the blocks before.
KINDS = {
    "sum": (F.sum, lambda own, carried: own + F.coalesce(carried, F.lit(0))),
    "xor": (F.bit_xor, lambda own, carried: own.bitwiseXOR(F.coalesce(carried, F.lit(0)))),
    "max": (F.max, lambda own, carried: F.greatest(own, carried)),
}


def running(rows: DataFrame, group: list[str], order: list[str], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with a running total, the row itself included, for each entry name: (kind, column) of ``totals``.

    Group columns are never null. Rows that are equal in group and order stay in one block, so callers merge copies
    first. The blocks are written to the shared folder: a task that runs again finds the same ones.
    """
    spark = rows.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(blocks, *group, *order).withColumn("_block", F.spark_partition_id())
    dealt = stored(dealt, "blocks")
    names = list(totals)

    key = F.struct(*group)
    ends = dealt.groupBy("_block").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    outer = dealt.join(F.broadcast(ends), "_block").where((key == F.col("_low")) | (key == F.col("_high")))
    sums = outer.groupBy("_block", *group).agg(*[KINDS[k][0](c).alias(f"_{n}") for n, (k, c) in totals.items()])
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        "_block", *group, *[KINDS[k][0](f"_{n}").over(before).alias(f"_{n}") for n, (k, _) in totals.items()]
    )

    until = Window.partitionBy("_block", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.select("*", *[KINDS[k][0](c).over(until).alias(n) for n, (k, c) in totals.items()])
    # Two rows a block at most.
    met = own.join(F.broadcast(carried), ["_block", *group], "left")
    met = met.withColumns({n: _meet(k, n) for n, (k, _) in totals.items()})
    return met.drop("_block", *[f"_{n}" for n in names])


def _meet(kind: str, name: str) -> Column:
    return KINDS[kind][1](F.col(name), F.col(f"_{name}"))
