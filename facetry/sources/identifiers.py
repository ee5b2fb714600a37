"""Identifier lists, one identifier per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = " \t\r\n\v\f"
INTEGER = "[+-]?[0-9]+"
# Fixed value: the message users know.
NOT_INTEGERS = "failed to convert to integer identifiers"


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file, or of a folder of them, as column ``value``."""
    return spark.read.text(path)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def classify_lines(lines: DataFrame) -> DataFrame:
    """Each line with its text and its integer, NULL where it is none; blank lines are dropped."""
    text = lines.select(trimmed(F.col("value")).alias("text")).where(F.col("text") != "")
    whole = F.col("text").rlike(f"^{INTEGER}$")
    return text.select("text", F.when(whole, F.col("text").try_cast("bigint")).alias("number"))


def parse_identifiers(lines: DataFrame, dtype: T.DataType) -> DataFrame:
    """The identifiers of a list as column ``id``, in the type of the column they are looked up in.

    A line that is no integer ends the job when the column holds integers; it is found while the list
    is read, without a pass of its own.
    """
    # Copies are merged by line, not by identifier: the join then shuffles the list itself, and adaptive
    # execution can split an identifier that most rows of the catalogue carry.
    parsed = classify_lines(lines).distinct()
    if isinstance(dtype, T.StringType):
        return parsed.select(F.col("text").alias("id"))
    number = F.when(F.col("number").isNotNull(), F.col("number")).otherwise(
        F.raise_error(F.concat(F.lit(NOT_INTEGERS + ": "), F.col("text"))).cast("bigint")
    )
    return parsed.select(number.alias("id"))
