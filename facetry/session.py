"""Spark session with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
    # Recording the call site of every column costs more than building the column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app_name: str = "facetry", master: str | None = None, **extra: str) -> SparkSession:
    """Return the running session, or start one.

    ``master`` is left to spark-submit unless it is given.  A local session gets a driver heap and as
    many shuffle partitions as it has cores; on a cluster both stay as configured, and adaptive
    execution coalesces the shuffle partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            cores = master.removeprefix("local").strip("[]") or "1"
            cores = str(os.cpu_count()) if cores == "*" else cores
            builder = builder.config("spark.sql.shuffle.partitions", cores)
            builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
            builder = builder.config("spark.ui.enabled", "false")
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
