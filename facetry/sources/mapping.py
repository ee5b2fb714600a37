"""The mapping table: which programme and carton each targeting bit stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_mapping(
    spark: SparkSession, path: str, mapper: str = "mapper", alt_name: str = "alt_name"
) -> DataFrame:
    """``(bit, mapper, alt_name)`` of a mapping whose row position is the bit number.

    The position comes from the files, not from the order in which Spark reads them: rows of earlier files,
    in the order of their names, plus the row's place in its own. A mapping with a column ``bit`` uses that.
    """
    df = spark.read.parquet(path)
    named = [F.col(mapper).alias("mapper"), F.col(alt_name).alias("alt_name")]
    if "bit" in df.columns:
        return df.select(F.col("bit").cast("int").alias("bit"), *named)
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), *named)
    # One row per file.
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file")) - F.col("n")
    placed = rows.join(sizes.select("file", before.alias("before")), "file")
    return placed.select((F.col("before") + F.col("place")).cast("int").alias("bit"), "mapper", "alt_name")
