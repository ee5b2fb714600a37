"""Projections, computed columns, categories and scalar functions."""

from pyspark.sql import functions as F

from facetry.functions.expressions import formula
from facetry.operators.categories import category_codes, category_guard, with_codes
from facetry.operators.computed import ComputedColumns
from facetry.operators.ranges import log_values
from workload.inputs import KEY_SQL, LINEITEM_KEY, lineitem, table
from workload.registry import query


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


@query("select_columns", sql="SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def select_columns(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def unit_columns(df):
    return ComputedColumns().add(df, "unit", "l_extendedprice / l_quantity").add(df, "unit2", "unit ** 2")


@query("vc_add", sql=f"SELECT {KEY_SQL}, l_extendedprice / l_quantity AS unit FROM lineitem")
def vc_add(spark, sf):
    df = lineitem(spark, sf)
    added = ComputedColumns().add(df, "unit", "l_extendedprice / l_quantity").apply(df)
    return added.select(*LINEITEM_KEY, "unit")


@query(
    "vc_nested",
    sql=f"SELECT {KEY_SQL}, round((l_extendedprice / l_quantity) ** 2, 2) AS unit2 FROM lineitem",
)
def vc_nested(spark, sf):
    df = lineitem(spark, sf)
    return rounded(unit_columns(df).apply(df).select(*LINEITEM_KEY, "unit2"), "unit2", digits=2)


@query(
    "vc_drop_cascade",
    sql=f"SELECT {KEY_SQL}, round(l_extendedprice * (1 - l_discount), 4) AS paid FROM lineitem",
)
def vc_drop_cascade(spark, sf):
    df = lineitem(spark, sf)
    left = unit_columns(df).add(df, "paid", "l_extendedprice * (1 - l_discount)").drop("unit")
    return rounded(left.apply(df).select(*LINEITEM_KEY, *left.names), *left.names, digits=4)


@query(
    "vc_arith",
    sql=f"""
SELECT {KEY_SQL}, round(CASE WHEN l_discount <> 0 THEN (l_extendedprice - l_quantity * 100) / l_discount END, 4) AS v
FROM lineitem
""",
)
def vc_arith(spark, sf):
    df = lineitem(spark, sf)
    value = formula(df, "(l_extendedprice - l_quantity * 100) / l_discount")
    return rounded(df.select(*LINEITEM_KEY, value.alias("v")), "v", digits=4)


@query(
    "vc_int_wide",
    sql=f"""
SELECT {KEY_SQL}, (l_partkey % 2000)::bigint * 1000000 * l_linenumber AS v, l_linenumber::bigint * 2000000000 AS w
FROM lineitem
""",
)
def vc_int_wide(spark, sf):
    """Products of two columns of 32 bits that need 64."""
    df = lineitem(spark, sf).withColumn("wide", (F.col("l_partkey") % 2000 * 1_000_000).cast("int"))
    values = [formula(df, text).alias(n) for n, text in (("v", "wide * l_linenumber"), ("w", "l_linenumber * 2000000000"))]
    return df.select(*LINEITEM_KEY, *values)


@query("vc_log10", sql="SELECT o_orderkey, round(4.44 + 4 * log10(o_totalprice / 5770), 6) AS lg FROM orders")
def vc_log10(spark, sf):
    df = table(spark, sf, "orders")
    return rounded(df.select("o_orderkey", formula(df, "4.44 + 4*log10(o_totalprice/5770)").alias("lg")), "lg")


@query(
    "vc_hr",
    sql="""
SELECT c_custkey,
       round(CASE WHEN c_custkey > 0 THEN c_acctbal - 5 * log10(c_custkey / 1000) END, 6) AS magnitude
FROM customer
""",
)
def vc_hr(spark, sf):
    df = table(spark, sf, "customer")
    value = formula(df, "c_acctbal - 5*log10(c_custkey*1e-3)")
    return rounded(df.select("c_custkey", value.alias("magnitude")), "magnitude")


@query(
    "log_color",
    sql="""
SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS color FROM customer
""",
)
def log_color(spark, sf):
    df = table(spark, sf, "customer")
    return rounded(df.select("c_custkey", log_values(df, "c_acctbal").alias("color")), "color")


@query(
    "category_codes",
    sql="""
SELECT o_orderkey, o_orderpriority, code
FROM orders JOIN (SELECT o_orderpriority, (row_number() OVER (ORDER BY o_orderpriority) - 1)::int AS code
                  FROM (SELECT DISTINCT o_orderpriority FROM orders)) USING (o_orderpriority)
""",
)
def coded_orders(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return with_codes(df, "o_orderpriority")


@query(
    "category_dictionary",
    sql="""
SELECT l_linestatus AS label, (row_number() OVER (ORDER BY l_linestatus) - 1)::int AS code
FROM (SELECT DISTINCT l_linestatus FROM lineitem)
""",
)
def category_dictionary(spark, sf):
    return category_codes(lineitem(spark, sf), "l_linestatus")


@query(
    "category_guard",
    sql="""
SELECT 'p_type' AS "column", count(DISTINCT p_type) AS n_distinct, count(DISTINCT p_type) < 10 AS allowed FROM part
UNION ALL
SELECT 'p_brand', count(DISTINCT p_brand), count(DISTINCT p_brand) < 10 FROM part
""",
)
def guarded_columns(spark, sf):
    return category_guard(table(spark, sf, "part"), ["p_type", "p_brand"])


def formulas(spark, sf, name, key, texts):
    """A table's key with one rounded column per formula."""
    df = table(spark, sf, name)
    columns = ComputedColumns()
    for column, text in texts.items():
        columns = columns.add(df, column, text)
    return rounded(columns.apply(df).select(key, *texts), *texts)


@query(
    "fn_math",
    sql="""
SELECT o_orderkey, round(abs(o_totalprice - 250000), 6) AS v_abs, round(sqrt(o_totalprice), 6) AS v_sqrt,
       round(exp(o_totalprice / 100000), 6) AS v_exp, round(ln(o_totalprice), 6) AS v_log,
       round(log10(o_totalprice), 6) AS v_log10, round(ln(1 + o_totalprice / 1000), 6) AS v_log1p,
       round(exp(o_totalprice / 500000) - 1, 6) AS v_expm1, floor(o_totalprice / 7) AS v_floor,
       ceil(o_totalprice / 7) AS v_ceil, least(o_totalprice, 100000) AS v_minimum,
       greatest(o_totalprice, 100000) AS v_maximum,
       greatest(100000, least(o_totalprice, 200000))::double AS v_clip,
       CASE WHEN o_totalprice > 250000 THEN o_totalprice ELSE -o_totalprice END AS v_where,
       round(power(10, o_totalprice / 100000), 6) AS v_power,
       round_even(o_totalprice / 7, 0) AS v_round
FROM orders
""",
)
def fn_math(spark, sf):
    return formulas(
        spark,
        sf,
        "orders",
        "o_orderkey",
        {
            "v_abs": "abs(o_totalprice - 250000)",
            "v_sqrt": "sqrt(o_totalprice)",
            "v_exp": "exp(o_totalprice / 100000)",
            "v_log": "log(o_totalprice)",
            "v_log10": "log10(o_totalprice)",
            "v_log1p": "log1p(o_totalprice / 1000)",
            "v_expm1": "expm1(o_totalprice / 500000)",
            "v_floor": "floor(o_totalprice / 7)",
            "v_ceil": "ceil(o_totalprice / 7)",
            "v_minimum": "minimum(o_totalprice, 100000)",
            "v_maximum": "maximum(o_totalprice, 100000)",
            "v_clip": "clip(o_totalprice, 100000, 200000)",
            "v_where": "where(o_totalprice > 250000, o_totalprice, -o_totalprice)",
            "v_power": "10 ** (o_totalprice / 100000)",
            "v_round": "round(o_totalprice / 7)",
        },
    )


@query(
    "fn_trig",
    sql="""
SELECT p_partkey, round(sin(p_retailprice), 6) AS v_sin, round(cos(p_retailprice), 6) AS v_cos,
       round(tan(p_size / 100), 6) AS v_tan, round(asin(p_size / 100), 6) AS v_arcsin,
       round(acos(p_size / 100), 6) AS v_arccos, round(atan(p_retailprice), 6) AS v_arctan,
       round(atan2(p_size, p_retailprice), 6) AS v_arctan2, round(sinh(p_size / 10), 6) AS v_sinh,
       round(cosh(p_size / 10), 6) AS v_cosh, round(tanh(p_size / 10), 6) AS v_tanh,
       round(radians(p_retailprice), 6) AS v_deg2rad, round(degrees(p_size), 6) AS v_rad2deg
FROM part
""",
)
def fn_trig(spark, sf):
    return formulas(
        spark,
        sf,
        "part",
        "p_partkey",
        {
            "v_sin": "sin(p_retailprice)",
            "v_cos": "cos(p_retailprice)",
            "v_tan": "tan(p_size / 100)",
            "v_arcsin": "arcsin(p_size / 100)",
            "v_arccos": "arccos(p_size / 100)",
            "v_arctan": "arctan(p_retailprice)",
            "v_arctan2": "arctan2(p_size, p_retailprice)",
            "v_sinh": "sinh(p_size / 10)",
            "v_cosh": "cosh(p_size / 10)",
            "v_tanh": "tanh(p_size / 10)",
            "v_deg2rad": "deg2rad(p_retailprice)",
            "v_rad2deg": "rad2deg(p_size)",
        },
    )


@query(
    "fn_bits",
    sql="""
SELECT (p_partkey // 8 % 57)::int AS byte, bit_or((1 << (p_partkey % 8))::int) AS mask,
       bit_and(p_size) AS common, count(*) AS n
FROM part GROUP BY 1
""",
)
def fn_bits(spark, sf):
    byte = F.expr("cast(p_partkey div 8 % 57 as int)")
    return (
        table(spark, sf, "part")
        .groupBy(byte.alias("byte"))
        .agg(
            F.bit_or(F.expr("shiftleft(1, cast(p_partkey % 8 as int))")).alias("mask"),
            F.bit_and("p_size").alias("common"),
            F.count("*").alias("n"),
        )
    )


@query(
    "fn_strings",
    sql="""
SELECT p_partkey, lower(p_name) AS v_lower, replace(p_name, ' ', '') AS v_packed,
       upper(p_name[1]) || lower(p_name[2:]) AS v_capital, len(string_split(p_name, ' ')) AS n_words,
       string_split(p_name, ' ')[1] AS first_word, contains(lower(p_name), 'bolt') AS has_bolt,
       regexp_matches(p_name, '^[a-m]') AS early, trim('  ' || p_name || ' ') AS v_trim
FROM part
""",
)
def fn_strings(spark, sf):
    name = F.col("p_name")
    words = F.split(name, " ")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.lower(name).alias("v_lower"),
        F.replace(name, F.lit(" "), F.lit("")).alias("v_packed"),
        F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.expr("substring(p_name, 2)"))).alias("v_capital"),
        F.size(words).cast("bigint").alias("n_words"),
        F.get(words, F.lit(0)).alias("first_word"),
        F.contains(F.lower(name), F.lit("bolt")).alias("has_bolt"),
        name.rlike("^[a-m]").alias("early"),
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("v_trim"),
    )


@query(
    "fn_cast",
    sql="""
SELECT o_orderkey, try_cast(o_orderkey::varchar AS bigint) AS whole,
       try_cast(o_orderpriority AS bigint) AS no_number,
       try_cast(substr(o_orderpriority, 1, 1) AS double) AS leading, o_custkey::varchar AS as_text
FROM orders
""",
)
def fn_cast(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").try_cast("bigint").alias("whole"),
        F.col("o_orderpriority").try_cast("bigint").alias("no_number"),
        F.substring("o_orderpriority", 1, 1).try_cast("double").alias("leading"),
        F.col("o_custkey").cast("string").alias("as_text"),
    )
