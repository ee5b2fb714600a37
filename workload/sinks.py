"""Exports and the stream."""

from pyspark.sql import functions as F

from facetry.functions.expressions import condition
from facetry.plans.subset import SubsetSpec
from facetry.sources.catalog import Catalog
from facetry.sources.exports import Manifest, export_batch, export_subset
from facetry.streaming.counts import count_arrivals
from facetry.streaming.histograms import stream_histogram
from facetry.workspace import new_folder
from workload.inputs import KEY_SQL, LINEITEM_KEY, lineitem_catalog, table
from workload.registry import query

EXPORT = SubsetSpec(
    name="few", dataset="N", expression="l_quantity > 30", flags=(), computed=(("unit", "l_extendedprice / l_quantity"),)
)


@query(
    "export_roundtrip",
    sql=f"""
SELECT {KEY_SQL}, l_extendedprice / l_quantity AS unit
FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 30
""",
)
def export_roundtrip(spark, sf):
    path, _ = export_subset(lineitem_catalog(spark, sf), EXPORT, new_folder(spark, "export"))
    return spark.read.parquet(path).select(*LINEITEM_KEY, "unit")


@query(
    "export_manifest",
    sql="""
SELECT 'few' AS name, 'complete' AS status, count(*) AS n_rows
FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 30
UNION ALL SELECT 'wrong', 'failed', NULL
UNION ALL SELECT 'nothing', 'failed', NULL
UNION ALL SELECT 'clean', 'complete', count(*) FROM lineitem WHERE l_returnflag = 'A' AND l_discount = 0
""",
)
def export_manifest(spark, sf):
    folder = new_folder(spark, "exports")
    manifest = Manifest(spark, f"{folder}/manifest")
    catalog: Catalog = lineitem_catalog(spark, sf)
    specs = [
        EXPORT,
        SubsetSpec(name="wrong", dataset="N", expression="no_such_column > 1"),
        SubsetSpec(name="nothing", dataset="N", expression="l_quantity > 1000", flags=()),
        SubsetSpec(name="clean"),
    ]
    export_batch(catalog, specs, folder, manifest)
    return manifest.read().select("name", "status", "n_rows")


@query(
    "stream_subset_count",
    sql="SELECT event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY 1",
)
def stream_subset_count(spark, sf):
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{sf}/events.parquet")
    return count_arrivals(stream, condition(events, "value > 20"), "event_type")


@query(
    "stream_histogram",
    sql="""
SELECT least(floor(value / 500.0 * 20), 19)::int AS x_bin, round(12.5 + 25.0 * least(floor(value / 500.0 * 20), 19), 6) AS x,
       count(*) AS n
FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1, 2
""",
)
def stream_values(spark, sf):
    """The histogram of a stream that delivers its table twice: a row that comes again is not counted again."""
    events = table(spark, sf, "events")
    once = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{sf}/events.parquet")
    timed = once.withColumn("ts", F.col("ts").cast("timestamp"))
    bins = stream_histogram(timed.unionAll(timed), "value", (0, 500), "ts", ["event_id"], delay="3650 days")
    return bins.withColumn("x", F.round("x", 6))
