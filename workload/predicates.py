"""Expression filters, quick flags, targeting bits, identifier lists and their combination."""

from operator import or_

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import functions as F

from facetry.functions.expressions import condition
from facetry.operators.crossfilter import CrossFilter
from facetry.operators.crossmatch import crossmatch_condition
from facetry.operators.quickflags import flag_condition
from facetry.operators.search import first_hits, fuzzy_search, glossary_search, hit_counts, unknown_names
from facetry.operators.targeting import target_condition
from facetry.operators.textindex import build_text_index, open_text_index
from facetry.plans.subset import SubsetSpec
from facetry.sources.identifiers import classify_lines
from facetry.sources.layouts import write_ordered
from facetry.workspace import new_folder
from workload.inputs import (
    CUSTOMER_LIST_SQL,
    CUSTOMER_PROFILE,
    KEY_SQL,
    LINEITEM_KEY,
    LINEITEM_PROFILE,
    ORDER_LIST_SQL,
    customer_list,
    flagged_parts,
    lineitem,
    lineitem_catalog,
    mapping,
    order_list,
    table,
    target_sql,
    with_missing,
    MISSING_SQL,
)
from workload.registry import query


def lines_where(text, where, invert=False):
    """Rows of ``lineitem`` under a filter text, with the SQL that finds the same."""

    def run(spark, sf):
        df = lineitem(spark, sf)
        return df.where(condition(df, text, invert)).select(*LINEITEM_KEY, "l_discount")

    return run, f"SELECT {KEY_SQL}, l_discount FROM lineitem WHERE {where}"


for name, text, where, invert in (
    ("expr_compare", "l_quantity >= 25", "l_quantity >= 25", False),
    ("expr_literal_left", "25 <= l_quantity", "25 <= l_quantity", False),
    ("expr_range", "10 < l_quantity <= 20", "l_quantity > 10 AND l_quantity <= 20", False),
    (
        "expr_bool",
        "(l_quantity < 5 | l_quantity > 45) & l_discount <= 0.05",
        "(l_quantity < 5 OR l_quantity > 45) AND l_discount <= 0.05",
        False,
    ),
    (
        "expr_out_of_range",
        "l_orderkey < 1e30 & l_partkey > -100000000000000000000 & (l_suppkey < 1e400 | l_linenumber > 1e19)",
        "true",
        False,
    ),
    ("expr_string", "l_linestatus == 'F'", "l_linestatus = 'F'", False),
    ("expr_invert", "l_quantity >= 25", "NOT (l_quantity >= 25)", True),
):
    run, sql = lines_where(text, where, invert)
    query(name, sql)(run)


@query(
    "expr_missing",
    sql=f"""
SELECT {KEY_SQL} FROM (SELECT *, {MISSING_SQL} AS x FROM lineitem)
WHERE (x > 45 AND NOT isnan(x)) OR NOT (x <= 49 OR (x > 40 AND NOT isnan(x)))
""",
)
def expr_missing(spark, sf):
    df = with_missing(lineitem(spark, sf))
    return df.where(condition(df, "x > 45") | condition(df, "x <= 49 | x > 40", True)).select(*LINEITEM_KEY)


def flagged_lines(dataset, flags, where, invert=False):
    def run(spark, sf):
        df = lineitem_catalog(spark, sf).slice(dataset)
        test = flag_condition(df, flags, dataset, LINEITEM_PROFILE, invert)
        return df.where(test).select(*LINEITEM_KEY)

    return run, f"SELECT {KEY_SQL} FROM lineitem WHERE l_returnflag = '{dataset}' AND {where}"


for name, dataset, flags, where, invert in (
    ("quick_flags", "A", ["bulk", "clean"], "l_quantity >= 25 AND l_discount = 0", False),
    ("quick_flags_skip", "N", ["clean", "final only"], "l_linestatus = 'F'", False),
    ("quick_flags_override", "R", ["clean", "bulk"], "l_tax = 0 AND l_quantity >= 25", False),
    ("quick_flags_invert", "A", ["bulk", "clean"], "NOT (l_quantity >= 25 AND l_discount = 0)", True),
):
    run, sql = flagged_lines(dataset, flags, where, invert)
    query(name, sql)(run)


def targeted_parts(cartons, mappers, combine="AND", mode="bitwise", invert=False):
    def run(spark, sf):
        test = target_condition(mapping(spark, sf), cartons, mappers, combine, invert, mode=mode)
        return flagged_parts(spark, sf).where(test).select("p_partkey")

    return run


BYTEWISE = "fl <> 0 AND msk <> 0"
M, C = "mapper IN ('BUILDING')", "alt_name IN ('carton_1', 'carton_6')"

for name, args, sql in (
    ("target_carton", (["carton_1", "carton_6"], []), target_sql(C)),
    ("target_mapper", ([], ["BUILDING", "MACHINERY"]), target_sql("mapper IN ('BUILDING', 'MACHINERY')")),
    ("target_and", (["carton_1", "carton_6"], ["BUILDING"], "AND"), target_sql(f"({M}) AND ({C})")),
    ("target_or", (["carton_1", "carton_6"], ["BUILDING"], "OR"), target_sql(f"({M}) OR ({C})")),
    ("target_xor", (["carton_1", "carton_6"], ["BUILDING"], "XOR"), target_sql(f"({M}) <> ({C})")),
    ("target_bitwise", (["carton_2"], []), target_sql("alt_name = 'carton_2'")),
    ("target_bytewise", (["carton_2"], [], "AND", "bytewise"), target_sql("alt_name = 'carton_2'", BYTEWISE)),
    (
        "target_invert",
        (["carton_1", "carton_6"], ["BUILDING"], "AND", "bitwise", True),
        target_sql(f"({M}) AND ({C})", invert=True),
    ),
):
    query(name, sql)(targeted_parts(*args))


@query("target_bit_cap", sql=target_sql("bit >= 440 AND bit < 456"))
def target_bit_cap(spark, sf):
    """Every mapping row from bit 440 on is selected; the rows past the last byte change nothing."""
    late = F.when(F.col("bit") >= 440, "late").otherwise("early")
    bits = mapping(spark, sf).withColumn("alt_name", late)
    return flagged_parts(spark, sf).where(target_condition(bits, ["late"])).select("p_partkey")


@query("crossmatch_int", sql=f"SELECT {KEY_SQL} FROM lineitem WHERE l_orderkey IN ({ORDER_LIST_SQL})")
def crossmatch_int(spark, sf):
    df = lineitem(spark, sf)
    test = crossmatch_condition(df, order_list(spark, sf), "order", "A", LINEITEM_PROFILE)
    return df.where(test).select(*LINEITEM_KEY)


@query("crossmatch_ordered", sql=f"SELECT {KEY_SQL} FROM lineitem WHERE l_orderkey IN ({ORDER_LIST_SQL})")
def crossmatch_ordered(spark, sf):
    """The same list looked up in the catalogue stored in the order of its identifier."""
    df = ordered_lines(spark, sf)
    profile = replace(LINEITEM_PROFILE, ordered_identifiers=frozenset({"order"}))
    return df.where(crossmatch_condition(df, order_list(spark, sf), "order", "A", profile)).select(*LINEITEM_KEY)


@lru_cache(maxsize=None)
def ordered_lines(spark, sf):
    path = new_folder(spark, "ordered")
    write_ordered(lineitem(spark, sf), path, "l_returnflag", ["l_orderkey"], ["l_orderkey", "l_partkey"])
    return spark.read.parquet(path)


@query("crossmatch_string", sql=f"SELECT c_custkey, c_name FROM customer WHERE c_name IN ({CUSTOMER_LIST_SQL})")
def crossmatch_string(spark, sf):
    df = table(spark, sf, "customer")
    test = crossmatch_condition(df, customer_list(spark, sf), "name", "A", CUSTOMER_PROFILE)
    return df.where(test).select("c_custkey", "c_name")


@query(
    "crossmatch_parse",
    sql="""
SELECT count(number) AS good, count(*) - count(number) AS bad, sum(number)::bigint AS total
FROM (SELECT try_cast(trim(value) AS bigint) AS number
      FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN o_orderkey || 'a' WHEN o_orderpriority = '5-LOW' THEN '  '
                        ELSE ' ' || o_orderkey || ' ' END AS value FROM orders)
      WHERE trim(value) <> '')
""",
)
def crossmatch_parse(spark, sf):
    key = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_orderstatus") == "P", F.concat(key, F.lit("a")))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("  "))
        .otherwise(F.concat(F.lit(" "), key, F.lit(" ")))
    )
    return classify_lines(table(spark, sf, "orders").select(line.alias("value"))).agg(
        F.count("number").alias("good"),
        F.count_if(F.col("number").isNull()).alias("bad"),
        F.sum("number").alias("total"),
    )


# Whole subsets ----------------------------------------------------------------------------------

FULL = SubsetSpec(dataset="N", expression="5 < l_quantity <= 40 & l_extendedprice > 2e3", flags=("final only",))
FULL_SQL = "l_quantity > 5 AND l_quantity <= 40 AND l_extendedprice > 2000"


def lines_of(spec, spark, sf, identifiers=None):
    return spec.compile(lineitem_catalog(spark, sf), identifiers).select(*LINEITEM_KEY, "l_discount")


@query(
    "subset_full",
    sql=f"""
SELECT {KEY_SQL}, l_discount FROM lineitem
WHERE l_returnflag = 'N' AND {FULL_SQL} AND l_linestatus = 'F' AND l_orderkey IN ({ORDER_LIST_SQL})
""",
)
def subset_full(spark, sf):
    return lines_of(FULL, spark, sf, order_list(spark, sf))


@query(
    "subset_inverted",
    sql=f"""
SELECT {KEY_SQL}, l_discount FROM lineitem
WHERE l_returnflag = 'N' AND NOT ({FULL_SQL}) AND NOT (l_linestatus = 'F') AND l_orderkey IN ({ORDER_LIST_SQL})
""",
)
def subset_inverted(spark, sf):
    inverted = SubsetSpec(dataset="N", expression=FULL.expression, flags=FULL.flags, invert=True)
    return lines_of(inverted, spark, sf, order_list(spark, sf))


@query(
    "subset_default",
    sql=f"SELECT {KEY_SQL}, l_discount FROM lineitem WHERE l_returnflag = 'A' AND l_discount = 0",
)
def subset_default(spark, sf):
    return lines_of(SubsetSpec(), spark, sf)


def three_views(df):
    views = CrossFilter()
    views.set("view1", condition(df, "l_quantity >= 10"))
    views.set("view2", condition(df, "l_extendedprice < 20000"))
    views.set("view3", condition(df, "l_linestatus == 'O'"))
    return views


@query(
    "crossfilter_others",
    sql=f"SELECT {KEY_SQL} FROM lineitem WHERE l_quantity >= 10 AND l_linestatus = 'O'",
)
def crossfilter_others(spark, sf):
    df = lineitem(spark, sf)
    return three_views(df).frame_for(df, "view2").select(*LINEITEM_KEY)


@query(
    "crossfilter_or",
    sql=f"SELECT {KEY_SQL} FROM lineitem WHERE l_extendedprice < 20000 OR l_linestatus = 'O'",
)
def crossfilter_or(spark, sf):
    df = lineitem(spark, sf)
    return three_views(df).frame_for(df, "view1", or_).select(*LINEITEM_KEY)


# Search -----------------------------------------------------------------------------------------


@query(
    "fuzzy_search",
    sql="""
SELECT p_partkey, p_name FROM part
WHERE regexp_matches(p_name, '(?i)((blue).*(anvil))|((anvil).*(blue))')
""",
)
def fuzzy_parts(spark, sf):
    return fuzzy_search(table(spark, sf, "part").select("p_partkey", "p_name"), "blue ANVIL", "p_name")


@query(
    "fuzzy_search_text",
    sql="""
SELECT doc_id FROM documents
WHERE regexp_matches(text, '(?i)((the).*(ing).*(ed))|((the).*(ed).*(ing))|((ing).*(the).*(ed))|((ing).*(ed).*(the))|((ed).*(the).*(ing))|((ed).*(ing).*(the))')
""",
)
def fuzzy_documents(spark, sf):
    return fuzzy_search(table(spark, sf, "documents"), "the ED ing", "text").select("doc_id")


@query(
    "fuzzy_search_indexed",
    sql="""
SELECT doc_id FROM documents
WHERE regexp_matches(text, '(?i)((the).*(ing).*(ed))|((the).*(ed).*(ing))|((ing).*(the).*(ed))|((ing).*(ed).*(the))|((ed).*(the).*(ing))|((ed).*(ing).*(the))')
""",
)
def indexed_documents(spark, sf):
    """The same search by an index of letter triples."""
    documents = table(spark, sf, "documents")
    return text_index(spark, sf).search(documents, "the ing ed").select("doc_id")


@lru_cache(maxsize=None)
def text_index(spark, sf):
    path = new_folder(spark, "index")
    build_text_index(table(spark, sf, "documents"), "text", path)
    return open_text_index(spark, path, "text")


@query(
    "glossary_search",
    sql="""
SELECT p_partkey, p_name, p_type FROM part
WHERE regexp_matches(p_name, '(?i)(small)') OR regexp_matches(p_type, '(?i)(small)')
""",
)
def glossary_parts(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return glossary_search(parts, "small", ["p_name", "p_type"])


@query(
    "glossary_top20",
    sql="""
SELECT p_partkey, p_name FROM part
WHERE regexp_matches(p_name, '(?i)(ring)') OR regexp_matches(p_type, '(?i)(ring)')
ORDER BY p_partkey LIMIT 20
""",
)
def glossary_first(spark, sf):
    hits = glossary_search(table(spark, sf, "part"), "ring", ["p_name", "p_type"])
    return first_hits(hits, "p_partkey").select("p_partkey", "p_name")


@query(
    "glossary_shown",
    sql="""
SELECT least(count(*), 20) AS shown, count(*) AS total FROM part
WHERE regexp_matches(p_name, '(?i)(ring)') OR regexp_matches(p_type, '(?i)(ring)')
""",
)
def glossary_shown(spark, sf):
    return hit_counts(table(spark, sf, "part"), "ring", ["p_name", "p_type"])


@query(
    "fuzzy_search_many",
    sql="""
SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line FROM documents)
WHERE contains(line, 'of') AND contains(line, 'ly') AND contains(line, 'ed') AND contains(line, 'wh')
  AND contains(line, 'ou') AND regexp_matches(line, 'nds.*sh|sh.*nds')
""",
)
def fuzzy_search_many(spark, sf):
    """Seven words, of which two can overlap."""
    return fuzzy_search(table(spark, sf, "documents"), "of LY ed wh ou nds sh", "text").select("doc_id")


@query(
    "expr_decimal",
    sql=f"""
SELECT {KEY_SQL} FROM lineitem
WHERE l_discount::decimal(10, 2) > 0.055 AND l_tax::decimal(10, 2) < 1000000000000
""",
)
def expr_decimal(spark, sf):
    df = lineitem(spark, sf)
    cast = df.withColumns({c: F.col(c).cast("decimal(10,2)") for c in ("l_discount", "l_tax")})
    return cast.where(condition(cast, "l_discount > 0.055 & l_tax < 1e12")).select(*LINEITEM_KEY)


@query(
    "unknown_names",
    sql="""
SELECT name FROM (VALUES ('A'), ('N'), ('X')) AS asked(name)
WHERE name NOT IN (SELECT l_returnflag FROM lineitem)
""",
)
def unknown_datasets(spark, sf):
    return unknown_names(lineitem(spark, sf), "l_returnflag", ["A", "N", "X"])
