"""Rows by the place they are read from: a file and a number in it.

A view of few rows of a wide table is found on the columns that order it, together with the address of each row.
Only then are the columns that are shown read, and only from the files that hold such rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE, NUMBER = "_file", "_number"
#: A number for the file: it orders files by one comparison. Files of one number are told apart by their path.
PLACE = "_place"
ADDRESS = (PLACE, NUMBER, FILE)

#: Addresses that are handed to the driver and broadcast at most.
MOST_ADDRESSES = 100_000
#: Addresses that stand in the filter itself.
LITERALS = 64

#: Plan nodes that hand on each row of their (left) input once or not at all.
ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "ResolvedHint", "View"}
SEMI = {"LeftSemi", "LeftAnti"}


def _reads_rows_of_files(plan) -> bool:
    """Whether each row of an analysed plan is one row of one table of files."""
    while True:
        name = plan.nodeName()
        if name == "LogicalRelation":
            return True
        if name == "Join":
            if plan.joinType().toString() not in SEMI:
                return False
            plan = plan.left()
        elif name in ROW_BY_ROW:
            plan = plan.child()
        else:
            return False


def with_address(df: DataFrame) -> DataFrame | None:
    """``df`` with the address of each row, or nothing where its rows are not rows of files."""
    if not _reads_rows_of_files(df._jdf.queryExecution().analyzed()):
        return None
    file, number = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        return df.select("*", F.xxhash64(file).alias(PLACE), number.alias(NUMBER), file.alias(FILE))
    except AnalysisException:  # a file format without row numbers
        return None


def at_addresses(addressed: DataFrame, found: pa.Table) -> DataFrame:
    """The rows of ``addressed`` at the addresses in ``found``, at most ``MOST_ADDRESSES``.

    Files without any of them are not opened.
    """
    if not found.num_rows:
        return addressed.where(F.lit(False))
    held = addressed.where(F.col(FILE).isin(found[FILE].unique().to_pylist()))
    if found.num_rows > LITERALS:
        return held.join(F.broadcast(addressed.sparkSession.createDataFrame(found)), [FILE, NUMBER], "left_semi")
    numbers: dict[str, list[int]] = {}
    for file, number in zip(found[FILE].to_pylist(), found[NUMBER].to_pylist(), strict=True):
        numbers.setdefault(file, []).append(number)
    return held.where(reduce(or_, [(F.col(FILE) == f) & F.col(NUMBER).isin(n) for f, n in numbers.items()]))
