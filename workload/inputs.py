"""How the given tables play the parts of a catalogue, and the SQL fragments that say the same.

``lineitem`` is the catalogue and its return flag the pipeline; ``part`` carries targeting bits derived
from its key; ``customer`` in file order is the mapping table.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.profile import CatalogProfile
from facetry.sources.catalog import Catalog, CatalogPaths, open_catalog
from facetry.sources.mapping import read_mapping

LINEITEM_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
KEY_SQL = ", ".join(LINEITEM_KEY)

LINEITEM_PROFILE = CatalogProfile(
    pipeline="l_returnflag",
    row_key=LINEITEM_KEY,
    quick_flags={
        "bulk": "l_quantity >= 25",
        "clean": "l_discount == 0",
        "final only": "l_linestatus == 'F'",
    },
    flag_overrides={"N": {"clean": None}, "R": {"clean": "l_tax == 0"}},
    default_flags=("clean",),
    identifiers={"order": "l_orderkey", "part": "l_partkey"},
    default_identifier="order",
    refused_identifiers=frozenset({("part", "R")}),
    default_datasets={"star": "A", "visit": "N"},
    dataset_aliases={"normal": "N"},
    default_x="l_quantity",
    default_y="l_extendedprice",
    default_color="l_discount",
    default_statistics=("l_quantity", "l_discount"),
    default_targets=("l_orderkey", "l_linenumber"),
)

CUSTOMER_PROFILE = CatalogProfile(identifiers={"name": "c_name"}, default_identifier="name")

N_BYTES = 57
N_BITS = N_BYTES * 8


@lru_cache(maxsize=None)
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table, opened once per session: its files are listed and its schema is read once."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


@lru_cache(maxsize=None)
def lineitem_catalog(spark: SparkSession, sf: str) -> Catalog:
    """``lineitem`` opened as the catalogue of a release; the folder of the tables is the release."""
    root, release = os.path.split(sf)
    paths = CatalogPaths(root, table="{root}/{release}/{datatype}.parquet")
    return open_catalog(spark, paths, release, "lineitem", LINEITEM_PROFILE)


# Missing values and a column that pipeline A lacks.


def with_missing(df: DataFrame) -> DataFrame:
    x = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).when(F.col("l_linenumber") != 6, F.col("l_quantity"))
    return df.withColumn("x", x)


MISSING_SQL = (
    "CASE WHEN l_linenumber = 7 THEN 'NaN'::double WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END"
)


# Targeting.


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_mapping(spark, f"{sf}/customer.parquet", "c_mktsegment", "c_nationkey")
    return rows.withColumn("alt_name", F.concat(F.lit("carton_"), F.col("alt_name")))


MAPPING_SQL = """
SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::int AS bit,
       c_mktsegment AS mapper, 'carton_' || c_nationkey AS alt_name
FROM customer
"""


def flagged_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with 57 flag bytes, in which two bits derived from the key are set."""
    part = table(spark, sf, "part")
    bits = [F.col("p_partkey") % N_BITS, (F.col("p_partkey") * 7 + 3) % N_BITS]
    named = part.withColumns({"b1": bits[0], "b2": bits[1]})
    flags = F.expr(
        f"""transform(sequence(0, {N_BYTES - 1}), i -> cast(
              (case when b1 div 8 = i then shiftleft(1, cast(b1 % 8 as int)) else 0 end)
            | (case when b2 div 8 = i then shiftleft(1, cast(b2 % 8 as int)) else 0 end) as smallint))"""
    )
    return named.withColumn("flags", flags).drop("b1", "b2")


FLAGS_SQL = f"""
SELECT p_partkey, list_transform(range({N_BYTES}), lambda i:
         (CASE WHEN (p_partkey % {N_BITS}) // 8 = i THEN (1 << (p_partkey % {N_BITS} % 8)::int) ELSE 0 END)
       | (CASE WHEN ((p_partkey*7+3) % {N_BITS}) // 8 = i THEN (1 << ((p_partkey*7+3) % {N_BITS} % 8)::int) ELSE 0 END)
       ) AS flags
FROM part
"""


def target_sql(selection: str, test: str = "(fl & msk) <> 0", invert: bool = False) -> str:
    """Rows whose flag bytes meet the mask of the mapping rows in ``selection``."""
    known = "NOT " if invert else ""
    return f"""
WITH mapping AS ({MAPPING_SQL}),
     masks AS (SELECT bit // 8 AS num, bit_or((1 << (bit % 8))::int) AS msk
               FROM mapping WHERE ({selection}) AND bit < {N_BITS} GROUP BY 1),
     bytes AS (SELECT p_partkey, unnest(range({N_BYTES})) AS num, unnest(flags) AS fl FROM ({FLAGS_SQL})),
     hits AS (SELECT DISTINCT p_partkey FROM bytes JOIN masks USING (num) WHERE {test})
SELECT p_partkey FROM part WHERE p_partkey {known}IN (SELECT p_partkey FROM hits)
"""


# Identifier lists: orders and customers of other tables, with copies and with names nobody has.


def order_list(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    lines = F.array(
        F.when(F.col("o_totalprice") > 400000, key),
        F.when(F.col("o_orderpriority") == "1-URGENT", key),
        (-F.col("o_orderkey") - 1).cast("string"),
    )
    return table(spark, sf, "orders").select(F.explode(F.array_compact(lines)).alias("value"))


ORDER_LIST_SQL = "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 OR o_orderpriority = '1-URGENT'"


def customer_list(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    name = F.concat(F.lit(" Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" "))
    return orders.select(name.alias("value"))


CUSTOMER_LIST_SQL = (
    "SELECT 'Customer#' || lpad(o_custkey::varchar, 9, '0') FROM orders WHERE o_orderstatus = 'P'"
)
