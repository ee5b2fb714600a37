"""Counts of a subset over rows that keep arriving.

The conditions of a subset are plain columns and hold for a stream as they do for a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.missing import column
from facetry.workspace import new_folder


def count_arrivals(stream: DataFrame, condition: Column, key: str, folder: str | None = None) -> DataFrame:
    """Count the rows of a stream that meet a condition, per value of ``key``, and return the totals.

    Takes all rows that have arrived, and stops.  The file sink records which files belong to which
    micro-batch, so a batch that is repeated after a failure is counted once.  A second call with the same
    ``folder`` takes only what has arrived since, and returns the totals of all calls.
    """
    folder = folder or new_folder(stream.sparkSession, "arrivals")
    kept = stream.where(condition).select(column(key))
    query = (
        kept.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(kept.schema).parquet(f"{folder}/rows")
    return rows.groupBy(column(key)).agg(F.count("*").alias("n"))
