"""All pairs inside groups of any size, in square cells of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_cells(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """The rows of groups with two members or more, once for each cell they belong to.

    A group of n rows is dealt into ceil(n / block) blocks by a hash of ``member``; the cell (low, high) holds the
    blocks low and high, and column ``own`` says which of them a row is from. Every pair of rows meets in one cell.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select(*keys, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    return dealt.drop("other", "blocks")
