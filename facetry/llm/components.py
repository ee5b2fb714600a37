"""Connected components of a large graph: every node gets the smallest node that it can reach.

Edges are rewritten by turns: each node tells its larger neighbours about the smallest node it knows
(large star), and its smaller neighbours too (small star), until every node stands next to the smallest of
its component. The number of turns grows with the logarithm of the longest path. Edges are merged before
each shuffle, and the table of each turn is written to the shared folder, so nothing depends on an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.workspace import new_folder


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again."""
    spark = frame.sparkSession
    path = new_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b. Returns node and component for all nodes of edges between different nodes."""
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        # Done when every node points to one node only, which itself points nowhere.
        roots = edges.select(F.col("v").alias("u")).distinct()
        torn = edges.groupBy("u").count().where("count > 1").select("u")
        if edges.join(roots, "u", "left_semi").select("u").unionByName(torn).isEmpty():
            break
    least = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    top = least.select(F.col("component").alias("node"), "component").distinct()
    return least.unionByName(top)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u")
    return (
        down.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )
