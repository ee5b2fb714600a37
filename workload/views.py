"""Selections, statistics, binned views, tables and whole requests."""

from dataclasses import replace
from functools import lru_cache, reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from facetry.functions.expressions import condition
from facetry.operators import ranges
from facetry.operators.binning import axes, heatmap, histogram, histogram_centers, histogram_edges, limits_of
from facetry.operators.compare import compare_subsets
from facetry.operators.crossfilter import CrossFilter
from facetry.operators.dashboard import BinnedView, all_views
from facetry.operators.selections import (
    select_bars,
    select_categories,
    select_cells,
    select_points,
    viewport,
)
from facetry.operators.summaries import (
    describe,
    distinct_count,
    minmax,
    pivot_counts,
    subset_count,
    subset_progress,
    unique_values,
    value_counts,
)
from facetry.operators.tables import page, scatter_points
from facetry.plans.request import run_request
from facetry.plans.subset import SubsetSpec
from facetry.plans.view import ViewSpec
from facetry.sources.layouts import write_clustered, write_sampled
from facetry.workspace import new_folder
from workload.inputs import KEY_SQL, LINEITEM_KEY, MISSING_SQL, lineitem, lineitem_catalog, table, with_missing
from workload.registry import query

QTY, PX, DISC = "l_quantity", "l_extendedprice", "l_discount"


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def ends_sql(name, source="lineitem", where="true"):
    return f"(SELECT min({name}) AS lo, max({name}) AS hi FROM {source} WHERE {where})"


def bin_sql(value, limits, bins):
    """The bin of a value, SQL."""
    return f"least(floor(({value} - {limits}.lo) / ({limits}.hi - {limits}.lo) * {bins}), {bins - 1})::int"


# Selections -------------------------------------------------------------------------------------


@query(
    "select_hist",
    sql=f"""
SELECT {KEY_SQL} FROM lineitem, {ends_sql(PX)} AS e
WHERE {PX} >= e.lo + 3 * (e.hi - e.lo) / 20 AND {PX} < e.lo + 7 * (e.hi - e.lo) / 20
""",
)
def select_hist(spark, sf):
    df = lineitem(spark, sf)
    ends = limits_of(df, [PX])[PX]
    return df.where(select_bars(df, PX, ends, 20, [3, 4, 5, 6])).select(*LINEITEM_KEY)


@query(
    "select_hist_centers",
    sql=f"""
SELECT {KEY_SQL} FROM lineitem, {ends_sql(PX)} AS e
WHERE {PX} >= e.lo + 3.5 * (e.hi - e.lo) / 20 AND {PX} <= e.lo + 6.5 * (e.hi - e.lo) / 20
""",
)
def select_hist_centers(spark, sf):
    df = lineitem(spark, sf)
    ends = limits_of(df, [PX])[PX]
    return df.where(select_bars(df, PX, ends, 20, [3, 6], mode="centers")).select(*LINEITEM_KEY)


@query(
    "select_hist_cat",
    sql="SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
)
def select_hist_cat(spark, sf):
    urgent = select_categories("o_orderpriority", ["1-URGENT", "5-LOW"])
    return table(spark, sf, "orders").where(urgent).select("o_orderkey")


@query(
    "select_heatmap",
    sql=f"""
SELECT {KEY_SQL} FROM lineitem, {ends_sql(QTY)} AS a, {ends_sql(PX)} AS b
WHERE {QTY} >= a.lo + 2 * (a.hi - a.lo) / 10 AND {QTY} < a.lo + 5 * (a.hi - a.lo) / 10
  AND {PX} >= b.lo + 7 * (b.hi - b.lo) / 10 AND {PX} <= b.lo + 10 * (b.hi - b.lo) / 10
""",
)
def select_heatmap(spark, sf):
    df = lineitem(spark, sf)
    ends = limits_of(df, [QTY, PX])
    box = select_cells(df, select_bars(df, QTY, ends[QTY], 10, [2, 4]), select_bars(df, PX, ends[PX], 10, [7, 8, 9]))
    return df.where(box).select(*LINEITEM_KEY)


@query(
    "select_heatmap_cat",
    sql=f"""
SELECT {KEY_SQL} FROM lineitem, {ends_sql(PX)} AS b
WHERE l_linestatus IN ('F') AND {PX} >= b.lo + (b.hi - b.lo) / 10 AND {PX} < b.lo + 4 * (b.hi - b.lo) / 10
""",
)
def select_heatmap_cat(spark, sf):
    df = lineitem(spark, sf)
    ends = limits_of(df, [PX])[PX]
    box = select_cells(df, select_categories("l_linestatus", ["F"]), select_bars(df, PX, ends, 10, [1, 3]))
    return df.where(box).select(*LINEITEM_KEY)


def picked_points(spark, sf):
    """The points of all lines with the largest price of their supplier."""
    best = lineitem(spark, sf).groupBy("l_suppkey").agg(F.max_by(F.struct(QTY, DISC), F.struct(PX, QTY, DISC)).alias("p"))
    return best.select(F.col(f"p.{QTY}").alias("x"), F.col(f"p.{DISC}").alias("y"))


PICKED_SQL = f"""
(SELECT DISTINCT {QTY} AS x, {DISC} AS y
 FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {PX} DESC, {QTY} DESC, {DISC} DESC) AS nth
       FROM lineitem) WHERE nth = 1)
"""


@query(
    "select_points",
    sql=f"SELECT {KEY_SQL} FROM lineitem WHERE ({QTY}, {DISC}) IN (SELECT (x, y) FROM {PICKED_SQL})",
)
def select_pairs(spark, sf):
    df = lineitem(spark, sf)
    return df.where(select_points(df, QTY, DISC, picked_points(spark, sf))).select(*LINEITEM_KEY)


@query(
    "select_points_independent",
    sql=f"""
SELECT {KEY_SQL} FROM lineitem
WHERE {QTY} IN (SELECT x FROM {PICKED_SQL}) AND {DISC} IN (SELECT y FROM {PICKED_SQL})
""",
)
def select_independent(spark, sf):
    df = lineitem(spark, sf)
    test = select_points(df, QTY, DISC, picked_points(spark, sf), mode="independent")
    return df.where(test).select(*LINEITEM_KEY)


@query(
    "viewport",
    sql=f"SELECT {KEY_SQL} FROM lineitem WHERE {QTY} > 10 AND {QTY} < 20 AND {PX} > 0 AND {PX} < 50000",
)
def visible_lines(spark, sf):
    df = lineitem(spark, sf)
    return df.where(viewport(df, QTY, (10, 20), PX, (0, 50000))).select(*LINEITEM_KEY)


@query(
    "viewport_clustered",
    sql=f"SELECT {KEY_SQL} FROM lineitem WHERE {QTY} > 10 AND {QTY} < 15 AND {PX} > 20000 AND {PX} < 30000",
)
def visible_clustered_lines(spark, sf):
    """A small box of a catalogue in which rows near in quantity and price lie together."""
    df = clustered_lines(spark, sf)
    return df.where(viewport(df, QTY, (10, 15), PX, (20000, 30000))).select(*LINEITEM_KEY)


@query(
    "log_positive",
    sql="SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer WHERE c_acctbal > 0",
)
def log_positive(spark, sf):
    return ranges.positive_range(table(spark, sf, "customer"), "c_acctbal")


# Statistics -------------------------------------------------------------------------------------


@query("subset_count", sql=f"SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'N' AND {QTY} > 30")
def counted(spark, sf):
    df = lineitem_catalog(spark, sf).slice("N")
    return subset_count(df, condition(df, "l_quantity > 30"))


@query(
    "subset_progress",
    sql=f"""
SELECT count(*) FILTER (WHERE {QTY} > 30) AS filtered, count(*) AS total,
       round(count(*) FILTER (WHERE {QTY} > 30) / greatest(count(*), 1) * 100, 6) AS percent
FROM lineitem WHERE l_returnflag = 'N'
""",
)
def progress(spark, sf):
    df = lineitem_catalog(spark, sf).slice("N")
    return rounded(subset_progress(df, condition(df, "l_quantity > 30")), "percent")


@query("minmax", sql=f"SELECT min({PX}) AS low, max({PX}) AS high FROM lineitem")
def price_range(spark, sf):
    return minmax(lineitem(spark, sf), PX)


@query("nunique", sql="SELECT count(DISTINCT p_brand) AS n_distinct FROM part")
def brands(spark, sf):
    return distinct_count(table(spark, sf, "part"), "p_brand")


@query("nunique_approx", sql="SELECT true AS within_5_percent")
def brands_about(spark, sf):
    parts = table(spark, sf, "part")
    exact = distinct_count(parts, "p_brand").scalar()
    about = distinct_count(parts, "p_brand", approximate=True)
    return about.select((F.abs(F.col("n_distinct") - exact) <= 0.05 * exact).alias("within_5_percent"))


@query("unique_values", sql="SELECT DISTINCT o_orderpriority FROM orders")
def priorities(spark, sf):
    return unique_values(table(spark, sf, "orders"), "o_orderpriority")


@query("unique_limit", sql="SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 10")
def first_brands(spark, sf):
    return unique_values(table(spark, sf, "part"), "p_brand", 10)


@query(
    "value_counts",
    sql="""
SELECT value, n, (row_number() OVER (ORDER BY n DESC, value))::int AS place
FROM (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1)
""",
)
def segments(spark, sf):
    """The counts with their place in the order in which they come."""
    counts = value_counts(table(spark, sf, "customer"), "c_mktsegment")
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


def describe_sql(name, source, value=None, dtype="double"):
    value = value or name
    return f"""
SELECT '{name}' AS "column", '{dtype}' AS data_type, count({value}) AS "count", count(*) - count({value}) AS na,
       round(avg({value}), 4) AS mean, round(stddev_pop({value}), 4) AS std,
       min({value})::double AS min, max({value})::double AS max
FROM {source}
"""


@query(
    "describe",
    sql=" UNION ALL ".join(
        [describe_sql(n, "lineitem") for n in (QTY, PX, DISC)] + [describe_sql("o_totalprice", "orders")]
    ),
)
def described(spark, sf):
    lines = describe(lineitem(spark, sf), [QTY, PX, DISC, "l_linestatus"])
    return rounded(lines.unionByName(describe(table(spark, sf, "orders"), ["o_totalprice"])), "mean", "std", digits=4)


@query(
    "describe_nan",
    sql=describe_sql("x", "lineitem", "CASE WHEN l_linenumber < 6 THEN l_quantity END")
    + " UNION ALL "
    + describe_sql("l_linenumber", "lineitem", dtype="int"),
)
def described_missing(spark, sf):
    lines = with_missing(lineitem(spark, sf))
    return rounded(describe(lines, ["x", "l_linenumber"]), "mean", "std", digits=4)


@query(
    "pivot_counts",
    sql="""
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS "F",
       count(*) FILTER (WHERE l_linestatus = 'O') AS "O"
FROM lineitem GROUP BY 1
""",
)
def pivoted(spark, sf):
    return pivot_counts(lineitem(spark, sf), "l_returnflag", "l_linestatus")


@query(
    "pivot_missing",
    sql="""
SELECT flag, count(*) FILTER (WHERE status = 'F') AS "F", count(*) FILTER (WHERE status = 'O') AS "O",
       count(*) FILTER (WHERE status IS NULL) AS missing
FROM (SELECT nullif(l_returnflag, 'R') AS flag, CASE WHEN l_linenumber <> 6 THEN l_linestatus END AS status FROM lineitem)
GROUP BY 1
""",
)
def pivot_with_missing(spark, sf):
    df = lineitem(spark, sf).select(
        F.expr("nullif(l_returnflag, 'R')").alias("flag"),
        F.when(F.col("l_linenumber") != 6, F.col("l_linestatus")).alias("status"),
    )
    return pivot_counts(df, "flag", "status", missing=True)


# One axis ---------------------------------------------------------------------------------------


@query(
    "bin_edges",
    sql=f"""
SELECT i::int AS i, round(lo + i * (hi - lo) / 20, 6) AS edge FROM {ends_sql(PX)}, (SELECT unnest(range(21)) AS i)
""",
)
def edges(spark, sf):
    return rounded(histogram_edges(lineitem(spark, sf), PX, 20), "edge")


@query(
    "bin_centers",
    sql=f"""
SELECT i::int AS i, round(lo + (i + 0.5) * (hi - lo) / 20, 6) AS center
FROM {ends_sql(PX)}, (SELECT unnest(range(20)) AS i)
""",
)
def centers(spark, sf):
    return rounded(histogram_centers(lineitem(spark, sf), PX, 20), "center")


def histogram_sql(value, source, bins, where="true"):
    return f"""
SELECT b AS x_bin, round(lo + (b + 0.5) * (hi - lo) / {bins}, 6) AS x, n
FROM (SELECT {bin_sql(value, 'e', bins)} AS b, e.lo, e.hi, count(*) AS n
      FROM {source}, {ends_sql(value, source)} AS e WHERE {where} GROUP BY ALL)
"""


@query("hist_numeric", sql=histogram_sql(PX, "lineitem", 20))
def hist_numeric(spark, sf):
    return rounded(histogram(lineitem(spark, sf), PX, 20), "x")


@query("hist_left_open", sql=histogram_sql(QTY, "lineitem", 20, f"{QTY} < e.hi"))
def hist_left_open(spark, sf):
    return rounded(histogram(lineitem(spark, sf), QTY, 20, closed="left"), "x")


@query(
    "hist_categorical",
    sql="""
SELECT (row_number() OVER (ORDER BY o_orderpriority) - 1)::int AS x_bin, o_orderpriority AS x, n
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
""",
)
def hist_categorical(spark, sf):
    return histogram(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "hist_dense",
    sql=f"""
WITH e AS {ends_sql('value', 'events')},
     c AS (SELECT {bin_sql('value', 'e', 50)} AS b, count(*) AS n FROM events, e GROUP BY 1)
SELECT i::int AS x_bin, round(lo + (i + 0.5) * (hi - lo) / 50, 6) AS x, coalesce(n, 0) AS n
FROM e, (SELECT unnest(range(50)) AS i) LEFT JOIN c ON b = i
""",
)
def hist_dense(spark, sf):
    return rounded(histogram(table(spark, sf, "events"), "value", 50, dense=True), "x")


@query(
    "hist_missing",
    sql=f"""
SELECT b AS x_bin, round(lo + (b + 0.5) * (hi - lo) / 20, 6) AS x, n
FROM (SELECT {bin_sql('x', 'e', 20)} AS b, e.lo, e.hi, count(*) AS n
      FROM (SELECT {MISSING_SQL} AS x FROM lineitem WHERE l_linenumber < 6),
           {ends_sql(QTY, 'lineitem', 'l_linenumber < 6')} AS e GROUP BY ALL)
""",
)
def hist_missing(spark, sf):
    return rounded(histogram(with_missing(lineitem(spark, sf)), "x", 20), "x")


# Two axes ---------------------------------------------------------------------------------------


def heatmap_sql(aggregate, source="lineitem", x=QTY, y=PX, bins=10):
    """A heat map over two numeric columns, SQL."""
    return f"""
SELECT cx AS x_bin, cy AS y_bin, round(xlo + (cx + 0.5) * (xhi - xlo) / {bins}, 6) AS x,
       round(ylo + (cy + 0.5) * (yhi - ylo) / {bins}, 6) AS y, value
FROM (SELECT {bin_sql(x, 'a', bins)} AS cx, {bin_sql(y, 'b', bins)} AS cy, a.lo AS xlo, a.hi AS xhi,
             b.lo AS ylo, b.hi AS yhi, {aggregate} AS value
      FROM {source}, {ends_sql(x, source)} AS a, {ends_sql(y, source)} AS b GROUP BY 1, 2, 3, 4, 5, 6)
"""


def price_map(statistic, digits=None, **options):
    def run(spark, sf):
        value = None if statistic == "count" else DISC
        cells = heatmap(lineitem(spark, sf), QTY, PX, value, statistic, bins=10, **options)
        return rounded(rounded(cells, "x", "y"), "value", digits=digits) if digits else rounded(cells, "x", "y")

    return run


for name, statistic, aggregate, digits in (
    ("heatmap_count", "count", "count(*)", None),
    ("heatmap_mean", "mean", f"round(avg({DISC}), 6)", 6),
    ("heatmap_median", "median", f"round(median({DISC}), 6)", 6),
    ("heatmap_sum", "sum", f"round(sum({DISC}), 4)", 4),
    ("heatmap_min", "min", f"min({DISC})", None),
    ("heatmap_max", "max", f"max({DISC})", None),
):
    query(name, heatmap_sql(aggregate))(price_map(statistic, digits))



@query(
    "heatmap_median_approx",
    sql=f"""
SELECT {bin_sql(QTY, 'a', 10)} AS x_bin, {bin_sql(PX, 'b', 10)} AS y_bin, true AS within_1_percent
FROM lineitem, {ends_sql(QTY)} AS a, {ends_sql(PX)} AS b GROUP BY 1, 2
""",
)
def heatmap_median_approx(spark, sf):
    """Whether the rank of each approximate median is within one percent of the middle."""
    df = lineitem(spark, sf)
    cells = heatmap(df, QTY, PX, DISC, "median", bins=10, approximate=True).select("x_bin", "y_bin", "value")
    rows = axes(df, {"x": QTY, "y": PX}, 10).place(df, F.col(DISC).alias("v")).join(cells, ["x_bin", "y_bin"])
    ranks = rows.groupBy("x_bin", "y_bin").agg(
        (F.count_if(F.col("v") < F.col("value")) / F.count("*")).alias("below"),
        (F.count_if(F.col("v") <= F.col("value")) / F.count("*")).alias("upto"),
    )
    return ranks.select("x_bin", "y_bin", ((F.col("below") <= 0.51) & (F.col("upto") >= 0.49)).alias("within_1_percent"))


query("heatmap_log", heatmap_sql("round(log10(count(*)), 6)"))(price_map("count", 6, log=True))


@query(
    "heatmap_median_wide",
    sql=heatmap_sql("round(median(l_tax * l_extendedprice), 4)"),
)
def heatmap_median_wide(spark, sf):
    """A median over a column with almost as many values as rows."""
    df = lineitem(spark, sf).withColumn("tax", F.col("l_tax") * F.col(PX))
    return rounded(rounded(heatmap(df, QTY, PX, "tax", "median", bins=10), "x", "y"), "value", digits=4)


@query(
    "heatmap_cat_x",
    sql=f"""
SELECT (CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END)::int AS x_bin, cy AS y_bin, l_linestatus AS x,
       round(lo + (cy + 0.5) * (hi - lo) / 10, 6) AS y, value
FROM (SELECT l_linestatus, {bin_sql(PX, 'b', 10)} AS cy, b.lo, b.hi, round(avg({DISC}), 6) AS value
      FROM lineitem, {ends_sql(PX)} AS b GROUP BY 1, 2, 3, 4)
""",
)
def heatmap_cat_x(spark, sf):
    cells = heatmap(lineitem(spark, sf), "l_linestatus", PX, DISC, "mean", bins=10)
    return rounded(cells, "y", "value")


@query(
    "heatmap_cat_xy",
    sql=f"""
SELECT (dense_rank() OVER (ORDER BY l_linestatus) - 1)::int AS x_bin,
       (dense_rank() OVER (ORDER BY l_returnflag) - 1)::int AS y_bin,
       l_linestatus AS x, l_returnflag AS y, value
FROM (SELECT l_linestatus, l_returnflag, round(avg({DISC}), 6) AS value FROM lineitem GROUP BY 1, 2)
""",
)
def heatmap_cat_xy(spark, sf):
    return rounded(heatmap(lineitem(spark, sf), "l_linestatus", "l_returnflag", DISC, "mean"), "value")


@query(
    "heatmap_dense",
    sql=f"""
WITH a AS {ends_sql('c_acctbal', 'customer')}, b AS {ends_sql('c_nationkey', 'customer')},
     c AS (SELECT {bin_sql('c_acctbal', 'a', 40)} AS cx, {bin_sql('c_nationkey', 'b', 40)} AS cy, count(*) AS value
           FROM customer, a, b GROUP BY 1, 2),
     g AS (SELECT (i // 40)::int AS x_bin, (i % 40)::int AS y_bin FROM (SELECT unnest(range(1600)) AS i))
SELECT x_bin, y_bin, round(a.lo + (x_bin + 0.5) * (a.hi - a.lo) / 40, 6) AS x,
       round(b.lo + (y_bin + 0.5) * (b.hi - b.lo) / 40, 6) AS y, value
FROM g LEFT JOIN c ON cx = x_bin AND cy = y_bin, a, b
""",
)
def heatmap_dense(spark, sf):
    df = table(spark, sf, "customer")
    return rounded(heatmap(df, "c_acctbal", "c_nationkey", statistic="count", bins=40, dense=True), "x", "y")


COMPARE_SQL = " UNION ALL ".join(
    f"""
SELECT '{name}' AS subset, cx AS x_bin, cy AS y_bin, round(a.lo + (cx + 0.5) * (a.hi - a.lo) / 10, 6) AS x,
       round(b.lo + (cy + 0.5) * (b.hi - b.lo) / 10, 6) AS y, value
FROM (SELECT {bin_sql(QTY, 'a', 10)} AS cx, {bin_sql(PX, 'b', 10)} AS cy, count(*) AS value
      FROM lineitem, {ends_sql(QTY)} AS a, {ends_sql(PX)} AS b WHERE {where} GROUP BY 1, 2),
     {ends_sql(QTY)} AS a, {ends_sql(PX)} AS b
"""
    for name, where in (("all", "true"), ("clean", f"{DISC} = 0"), ("bulk", f"{QTY} >= 25"))
)


def compared_by(statistic, digits):
    def compared(spark, sf):
        df = lineitem(spark, sf)
        subsets = {"all": None, "clean": condition(df, "l_discount == 0"), "bulk": condition(df, "l_quantity >= 25")}
        value = None if statistic == "count" else "l_tax"
        cells = rounded(compare_subsets(df, subsets, QTY, PX, value, statistic, bins=10), "x", "y")
        return cells if digits is None else rounded(cells, "value", digits=digits)

    return compared


query("compare_subsets", sql=COMPARE_SQL)(compared_by("count", None))
query("compare_mean", sql=COMPARE_SQL.replace("count(*)", "round(avg(l_tax), 6)"))(compared_by("mean", 6))
query("compare_median", sql=COMPARE_SQL.replace("count(*)", "round(median(l_tax), 6)"))(compared_by("median", 6))


@query(
    "targets_page_text",
    sql="""
SELECT row, c_name, c_acctbal FROM
 (SELECT (row_number() OVER (ORDER BY c_name) - 1)::int AS row, c_name, c_acctbal FROM customer)
WHERE row >= (SELECT count(*) // 20 * 10 FROM customer) AND row < (SELECT count(*) // 20 * 10 FROM customer) + 10
""",
)
def page_by_text(spark, sf):
    """A page in the middle of a table, by a text key."""
    customers = table(spark, sf, "customer")
    return page(customers, ["c_name"], customers.count() // 20, columns=["c_name", "c_acctbal"])


@query(
    "targets_page_ties",
    sql="""
SELECT row, l_partkey FROM (SELECT (row_number() OVER (ORDER BY l_partkey) - 1)::int AS row, l_partkey FROM lineitem)
WHERE row >= 4000 AND row < 4010
""",
)
def page_with_ties(spark, sf):
    """Many rows share a key."""
    return page(lineitem(spark, sf), ["l_partkey"], 400, columns=["l_partkey"])


# Ranges -----------------------------------------------------------------------------------------


@query(
    "color_range_heatmap",
    sql=f"SELECT 0.0::double AS low, max(value)::double AS high FROM ({heatmap_sql('count(*)')})",
)
def color_range_heatmap(spark, sf):
    cells = heatmap(lineitem(spark, sf), QTY, PX, statistic="count", bins=10)
    return ranges.heatmap_color_range(cells, "count")


@query(
    "color_range_scatter",
    sql="""
SELECT round(min(log10(c_acctbal)), 6) AS low, round(max(log10(c_acctbal)), 6) AS high FROM customer
WHERE c_acctbal > 0
""",
)
def color_range_scatter(spark, sf):
    return rounded(ranges.scatter_color_range(table(spark, sf, "customer"), "c_acctbal", log=True), "low", "high")


@query(
    "axis_range",
    sql=f"""
SELECT round(lo - (hi - lo) / 20, 6) AS start, round(hi + (hi - lo) / 20, 6) AS end FROM {ends_sql(PX)}
""",
)
def axis_range(spark, sf):
    return rounded(ranges.axis_range(lineitem(spark, sf), PX), "start", "end")


@query(
    "axis_range_log",
    sql=f"""
SELECT round(power(10, hi + (hi - lo) / 20), 4) AS start, round(power(10, lo - (hi - lo) / 20), 4) AS end
FROM {ends_sql('log10(c_acctbal)', '(SELECT * FROM customer WHERE c_acctbal > 0)')}
""",
)
def axis_range_log(spark, sf):
    turned = ranges.axis_range(table(spark, sf, "customer"), "c_acctbal", log=True, flip=True)
    return rounded(turned, "start", "end", digits=4)


@query(
    "axis_range_cat",
    sql="""
SELECT (0 - 1.2)::double AS start, (count(DISTINCT o_orderpriority) - 1 + 1.2)::double AS end FROM orders
""",
)
def axis_range_cat(spark, sf):
    return ranges.axis_range(table(spark, sf, "orders"), "o_orderpriority", "histogram")


# Tables -----------------------------------------------------------------------------------------


@query(
    "targets_page",
    sql="""
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "row", o_orderkey, o_totalprice FROM orders
ORDER BY o_orderkey LIMIT 10 OFFSET 30
""",
)
def targets_page(spark, sf):
    shown = page(table(spark, sf, "orders"), ["o_orderkey"], 3, columns=["o_orderkey", "o_totalprice"])
    return shown.withColumn("row", F.col("row").cast("bigint"))


SAMPLE_SQL = f"""
SELECT {QTY} AS x, {PX} AS y, {DISC} AS color, l_orderkey, l_partkey, l_suppkey, l_linenumber
FROM lineitem WHERE l_returnflag = 'N'
ORDER BY md5('42:' || l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':'
             || round({PX} * 100)::bigint) LIMIT 10000
"""


@query("scatter_sample", sql=SAMPLE_SQL)
def scatter_sample(spark, sf):
    return scatter_points(lineitem_catalog(spark, sf).slice("N"), QTY, PX, DISC, sample_key())


@query("scatter_sample_layout", sql=SAMPLE_SQL)
def scatter_sample_layout(spark, sf):
    """The same points from the catalogue stored in the order of its shuffle."""
    rows = sampled_lines(spark, sf).where("l_returnflag = 'N'")
    return scatter_points(rows, QTY, PX, DISC, sample_key())


def sample_key():
    return [*LINEITEM_KEY[:4], F.round(F.col(PX) * 100).cast("bigint")]


@lru_cache(maxsize=None)
def sampled_lines(spark, sf):
    path = new_folder(spark, "sampled")
    write_sampled(lineitem(spark, sf), path, "l_returnflag", sample_key())
    return spark.read.parquet(path)


@lru_cache(maxsize=None)
def clustered_lines(spark, sf):
    path = new_folder(spark, "clustered")
    write_clustered(lineitem(spark, sf), path, "l_returnflag", [QTY, PX])
    return spark.read.parquet(path)


# Whole requests ---------------------------------------------------------------------------------

FLAGSHIP_SUBSET = SubsetSpec(
    dataset="N", expression="(l_quantity < 5 | l_quantity > 45) & l_discount <= 0.05", flags=()
)
FLAGSHIP_VIEW = ViewSpec("heatmap", x=QTY, y=PX, color=DISC, bins=10)
FLAGSHIP_ROWS = f"""
(SELECT * FROM lineitem WHERE l_returnflag = 'N' AND ({QTY} < 5 OR {QTY} > 45) AND {DISC} <= 0.05)
"""


@query("flagship", sql=heatmap_sql(f"round(avg({DISC}), 6)", FLAGSHIP_ROWS))
def flagship(spark, sf):
    cells = run_request(lineitem_catalog(spark, sf), FLAGSHIP_SUBSET, FLAGSHIP_VIEW)
    return rounded(cells, "x", "y", "value")


VIEWS = (
    ViewSpec("histogram", x=PX, dense=True),
    ViewSpec("heatmap", x=QTY, y=PX, color=DISC, bins=10),
    ViewSpec("scatter", x=QTY, y=PX, color=DISC),
    ViewSpec("stats", columns=(QTY, PX, DISC)),
    ViewSpec("targets", page=1),
)


LONG_ROWS = {
    "histogram": ("x_bin", "NULL", "n"),
    "heatmap": ("x_bin", "y_bin", "round(value, 6)"),
    "scatter": ("x", "y", "color"),
    "stats": ("round(min, 6)", "round(max, 6)", "round(mean, 6)"),
    "targets": ("row", "l_orderkey", "l_linenumber"),
}


@query(
    "view_dispatch",
    sql=f"""
WITH rows_ AS {FLAGSHIP_ROWS}, e AS {ends_sql(PX, FLAGSHIP_ROWS)},
counts AS (SELECT {bin_sql(PX, 'e', 20)} AS bin, count(*) AS n FROM rows_, e GROUP BY 1),
cells AS ({heatmap_sql('round(avg(l_discount), 6)', FLAGSHIP_ROWS)}),
points AS (
  SELECT * FROM rows_
  ORDER BY md5('42:' || l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber) LIMIT 10000),
listed AS (SELECT (row_number() OVER (ORDER BY {', '.join(LINEITEM_KEY[:4])}) - 1) AS row, * FROM rows_)
SELECT 'histogram' AS view, i::double AS a, NULL::double AS b, coalesce(n, 0)::double AS value
FROM range(20) AS g(i) LEFT JOIN counts ON bin = i
UNION ALL SELECT 'heatmap', x_bin, y_bin, value FROM cells
UNION ALL SELECT 'scatter', {QTY}, {PX}, {DISC} FROM points
UNION ALL SELECT 'stats', min({QTY}), max({QTY}), round(avg({QTY}), 6) FROM rows_
UNION ALL SELECT 'stats', min({PX}), max({PX}), round(avg({PX}), 6) FROM rows_
UNION ALL SELECT 'stats', min({DISC}), max({DISC}), round(avg({DISC}), 6) FROM rows_
UNION ALL SELECT 'targets', row, l_orderkey, l_linenumber FROM listed WHERE row BETWEEN 10 AND 19
""",
)
def view_dispatch(spark, sf):
    """The rows of every kind of view, as (view, a, b, value)."""
    catalog = lineitem_catalog(spark, sf)
    catalog = replace(catalog, profile=replace(catalog.profile, row_key=LINEITEM_KEY[:4]))
    shown = []
    for view in VIEWS:
        a, b, value = (F.expr(text).cast("double") for text in LONG_ROWS[view.kind])
        rows = run_request(catalog, FLAGSHIP_SUBSET, view)
        shown.append(rows.select(F.lit(view.kind).alias("view"), a.alias("a"), b.alias("b"), value.alias("value")))
    return reduce(lambda a, b: a.unionAll(b), shown)


# Dashboards -------------------------------------------------------------------------------------

DASHBOARD = {
    "price": BinnedView(PX, limits={PX: (0, 105000)}),
    "quantity": BinnedView(QTY, value=DISC, statistic="mean", bins=10, limits={QTY: (0, 50)}),
    "map": BinnedView(QTY, PX, "l_tax", "max", 10, limits={QTY: (0, 50), PX: (0, 105000)}),
    "status": BinnedView("l_linestatus"),
}
SELECTED = {"price": "l_extendedprice < 40000", "quantity": "l_quantity >= 10", "status": "l_linestatus == 'O'"}


def fixed_bin_sql(value, high, bins):
    return f"least(floor({value} / {high} * {bins}), {bins - 1})::int"


def others_sql(view):
    return " AND ".join(f"({text.replace('==', '=')})" for key, text in SELECTED.items() if key != view)


@query(
    "crossfilter_all_views",
    sql=f"""
SELECT 'price' AS view, {fixed_bin_sql(PX, '105000.0', 20)} AS x_bin, NULL::int AS y_bin, NULL::varchar AS x_label,
  count(*)::double AS value FROM lineitem WHERE {others_sql('price')} GROUP BY 2
UNION ALL SELECT 'quantity', {fixed_bin_sql(QTY, '50.0', 10)}, NULL, NULL, round(avg({DISC}), 6)
FROM lineitem WHERE {others_sql('quantity')} GROUP BY 2
UNION ALL SELECT 'map', {fixed_bin_sql(QTY, '50.0', 10)} AS x_bin, {fixed_bin_sql(PX, '105000.0', 10)} AS y_bin, NULL, max(l_tax)
FROM lineitem WHERE {others_sql('map')} GROUP BY 2, 3
UNION ALL SELECT 'status', CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, NULL, l_linestatus, count(*)
FROM lineitem WHERE {others_sql('status')} GROUP BY l_linestatus
""",
)
def crossfilter_all_views(spark, sf):
    df = lineitem(spark, sf)
    selections = CrossFilter()
    for key, text in SELECTED.items():
        selections.set(key, condition(df, text))
    bins = all_views(df, selections, DASHBOARD)
    return bins.select("view", "x_bin", "y_bin", "x_label", F.round("value", 6).alias("value"))
