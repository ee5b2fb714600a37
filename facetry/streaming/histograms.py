"""A histogram of rows that keep arriving.

The counts of the bins are the state of the stream: a batch of new rows changes them, and nothing that has been counted is
read again.  A row that is delivered twice within the delay is counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.missing import column, drawable
from facetry.operators.binning import HISTOGRAM_BINS, bin_center, bin_number
from facetry.workspace import new_folder

DELAY = "1 day"


def stream_histogram(
    stream: DataFrame,
    x: str,
    limits: tuple[float, float],
    time: str,
    key: list[str],
    bins: int = HISTOGRAM_BINS,
    delay: str = DELAY,
    folder: str | None = None,
) -> DataFrame:
    """Take all rows that have arrived and return ``(x_bin, x, n)`` of all calls with this ``folder``.

    ``time`` is when a row was made and ``key`` tells rows apart: of rows with one key only the first counts, as long as
    they are no further apart than ``delay``; rows later than that behind the newest are dropped.  Each batch writes the
    bins that it has changed under its own number, so one that is repeated after a failure overwrites itself.
    """
    folder = folder or new_folder(stream.sparkSession, "histogram")
    value = column(x)
    low, high = limits
    inside = drawable(stream, x) & (value >= F.lit(float(low))) & (value <= F.lit(float(high)))
    once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)
    placed = once.where(inside).select(bin_number(value, limits, bins).alias("x_bin"))
    counts = placed.groupBy("x_bin").agg(F.count("*").alias("n"))

    def keep_changes(changed: DataFrame, batch: int) -> None:
        changed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch}")

    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(keep_changes)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # At most one row per bin and batch; the newest has the total.
    changes = stream.sparkSession.read.schema("x_bin int, n bigint, batch bigint").parquet(f"{folder}/counts")
    latest = changes.groupBy("x_bin").agg(F.max_by("n", "batch").alias("n"))
    return latest.select("x_bin", bin_center(F.col("x_bin"), limits, bins).alias("x"), "n")
