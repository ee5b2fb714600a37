"""Sources and the ingest jobs around them."""

from functools import reduce

from pyspark.sql import functions as F

from facetry.operators.tables import seeded_shuffle
from facetry.sources.catalog import build_allowed_columns, keep, materialise, stack, write_catalog
from facetry.sources.metadata import (
    build_glossary,
    read_allowed_columns,
    read_glossary,
    write_allowed_columns,
    write_glossary,
)
from facetry.sources.sketches import build_sketches, distinct_from_sketches
from facetry.workspace import new_folder
from workload.inputs import KEY_SQL, LINEITEM_KEY, MAPPING_SQL, lineitem, lineitem_catalog, mapping, table
from workload.registry import query


@query("scan_catalog", sql="SELECT * FROM lineitem")
def scan_catalog(spark, sf):
    return lineitem_catalog(spark, sf).table


@query("dataset_slice", sql=f"SELECT {KEY_SQL}, l_shipdate FROM lineitem WHERE l_returnflag = 'N'")
def dataset_slice(spark, sf):
    return lineitem_catalog(spark, sf).slice("N").select(*LINEITEM_KEY, "l_shipdate")


@query("dataset_list", sql="SELECT DISTINCT l_returnflag FROM lineitem")
def dataset_list(spark, sf):
    return lineitem_catalog(spark, sf).datasets()


@query("mapping_bits", sql=MAPPING_SQL)
def mapping_bits(spark, sf):
    return mapping(spark, sf)


def catalogue_with_gap(spark, sf):
    """``lineitem`` with a column that holds nothing on pipeline A."""
    gap = F.when(F.col("l_returnflag") == "A", F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return lineitem(spark, sf).withColumn("gap", gap)


ALLOWED_SQL = """
SELECT dataset, "column" FROM (
  UNPIVOT (SELECT l_returnflag AS dataset, count(l_orderkey) AS l_orderkey, count(l_partkey) AS l_partkey,
                  count(l_suppkey) AS l_suppkey, count(l_linenumber) AS l_linenumber,
                  count(l_quantity) AS l_quantity, count(l_extendedprice) AS l_extendedprice,
                  count(l_discount) AS l_discount, count(l_tax) AS l_tax, count(l_linestatus) AS l_linestatus,
                  count(l_shipdate) AS l_shipdate,
                  count(CASE WHEN l_returnflag <> 'A' THEN l_tax END) AS gap
           FROM lineitem GROUP BY 1)
  ON COLUMNS(* EXCLUDE dataset) INTO NAME "column" VALUE n)
WHERE n > 0
"""


@query("allowed_columns_build", sql=ALLOWED_SQL)
def allowed_columns_build(spark, sf):
    return build_allowed_columns(catalogue_with_gap(spark, sf), "l_returnflag")


@query("allowed_columns_load", sql=ALLOWED_SQL)
def allowed_columns_load(spark, sf):
    path = new_folder(spark, "allowed")
    write_allowed_columns(build_allowed_columns(catalogue_with_gap(spark, sf), "l_returnflag"), path)
    return read_allowed_columns(spark, path)


def part_products(spark, sf):
    """Parts as entries of products: the size is the product's number, the type its release."""
    return table(spark, sf, "part").select(
        F.col("p_type").alias("release"),
        F.col("p_size").alias("product_no"),
        F.col("p_partkey").alias("entry_no"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("made as "), F.col("p_brand")).alias("description"),
        F.lit("text").alias("type"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("unit"),
    )


GLOSSARY_SQL = """
SELECT p_name AS name, 'made as ' || p_brand AS description, 'text' AS type, 'size ' || p_size AS unit
FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey DESC) AS nth
      FROM part WHERE p_type = 'ECONOMY')
WHERE nth = 1
"""


@query("glossary_build", sql=GLOSSARY_SQL)
def glossary_build(spark, sf):
    return build_glossary(part_products(spark, sf), "ECONOMY", ["product_no", "entry_no"])


@query("glossary_load", sql=GLOSSARY_SQL)
def glossary_load(spark, sf):
    path = new_folder(spark, "glossary")
    write_glossary(build_glossary(part_products(spark, sf), "ECONOMY", ["product_no", "entry_no"]), path)
    return read_glossary(spark, path)


@query(
    "stack_catalogs",
    sql="""
SELECT pipeline, count(*) AS n, count(*) - count(segment) AS no_segment, round(sum(acctbal), 4) AS acctbal
FROM (SELECT 'customer' AS pipeline, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
      UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier)
GROUP BY 1
""",
)
def stack_catalogs(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")
    )
    path = new_folder(spark, "stacked")
    write_catalog(stack({"customer": customers, "supplier": suppliers}, "pipeline"), path, "pipeline", ["key"])
    return (
        spark.read.parquet(path)
        .groupBy("pipeline")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("segment").isNull()).alias("no_segment"),
            F.round(F.sum("acctbal"), 4).alias("acctbal"),
        )
    )


@query(
    "slice_persist",
    sql="""
SELECT l_linestatus, count(*) FILTER (WHERE l_quantity >= 25) AS bulk, count(*) AS n
FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1
""",
)
def slice_persist(spark, sf):
    kept = keep(lineitem_catalog(spark, sf).slice("N").select("l_linestatus", "l_quantity"))
    bulk = kept.where("l_quantity >= 25").groupBy("l_linestatus").agg(F.count("*").alias("bulk"))
    return kept.groupBy("l_linestatus").agg(F.count("*").alias("n")).join(bulk, "l_linestatus")


@query(
    "slice_materialise",
    sql="""
SELECT l_linestatus, count(*) FILTER (WHERE l_quantity >= 25) AS bulk, count(*) AS n
FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1
""",
)
def slice_materialise(spark, sf):
    """A slice that is written once and read for two counts."""
    kept = materialise(lineitem_catalog(spark, sf).slice("N").select("l_linestatus", "l_quantity"))
    bulk = kept.where("l_quantity >= 25").groupBy("l_linestatus").agg(F.count("*").alias("bulk"))
    return kept.groupBy("l_linestatus").agg(F.count("*").alias("n")).join(bulk, "l_linestatus")


@query(
    "nunique_sketch",
    sql="""
SELECT name AS column, true AS within_5_percent
FROM (VALUES ('l_partkey'), ('l_quantity'), ('l_shipdate'), ('l_linestatus')) AS t(name)
""",
)
def nunique_sketch(spark, sf):
    """Distinct values of two pipelines from the sketches of their slices, against exact counts."""
    lines, names = lineitem(spark, sf), ["l_partkey", "l_quantity", "l_shipdate", "l_linestatus"]
    sketches = materialise(build_sketches(lines, "l_returnflag", names))
    exact = lines.where("l_returnflag IN ('A', 'N')").agg(*[F.count_distinct(n).alias(n) for n in names])
    exact = exact.agg(F.first(F.struct(*names))).scalar()
    about = [
        distinct_from_sketches(sketches, n, ["A", "N"]).select(
            F.lit(n).alias("column"),
            (F.abs(F.col("n_distinct") - exact[n]) <= 0.05 * exact[n]).alias("within_5_percent"),
        )
        for n in names
    ]
    return reduce(lambda a, b: a.unionAll(b), about)


@query("seeded_shuffle", sql="SELECT o_orderkey, o_totalprice, md5('42:' || o_orderkey) AS shuffle_key FROM orders")
def shuffled_orders(spark, sf):
    return seeded_shuffle(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
