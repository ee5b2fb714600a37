"""Rows found by address, and layouts that let the reader leave out most of a table."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.functions.missing import column
from facetry.functions.text import has_words
from facetry.operators import textindex
from facetry.operators.addresses import at_addresses, with_address
from facetry.operators.crossmatch import crossmatch_condition, identifier_ranges
from facetry.operators.selections import viewport
from facetry.operators.tables import SHUFFLE, page, scatter_points, seeded_sample, seeded_shuffle
from facetry.operators.textindex import build_text_index, open_text_index, triples_of
from facetry.profile import CatalogProfile
from facetry.sources.layouts import cluster_parts, write_clustered, write_ordered, write_sampled

ROWS = 40_000


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A table of files with 40 columns, copies of keys, and rows of odd values."""
    path = str(tmp_path_factory.mktemp("wide") / "table")
    rows = spark.range(0, ROWS, numPartitions=6).select(
        "id",
        (F.col("id") % 977).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("x"),
        F.exp(F.randn(3) * 2).alias("y"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("pipeline"),
        *[(F.col("id") * i).alias(f"w{i}") for i in range(35)],
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def scans_of(df):
    """(columns read, filters, rows read) of every scan of a frame that has been collected."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            names = {node.requiredSchema().apply(i).name() for i in range(node.requiredSchema().size())}
            metrics = node.metrics()
            found.append((names, node.toString(), metrics.apply("numOutputRows").value(), metrics.apply("numFiles").value()))
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_addresses_are_those_of_rows_of_files(spark, wide):
    assert with_address(spark.range(3)) is None
    assert with_address(wide.union(wide)) is None
    assert with_address(wide.join(wide.select("k").distinct(), "k")) is None
    assert with_address(wide.groupBy("k").count()) is None
    assert with_address(wide.withColumn("e", F.explode(F.array(F.lit(1), F.lit(2))))) is None
    other = spark.range(0, 500, 7).select(F.col("id").alias("other"))
    semi = wide.where("id < 500").withColumn("z", F.col("id") + 1).join(other, F.col("id") == F.col("other"), "left_semi")
    addressed = with_address(semi)
    wanted = addressed.where("z % 3 = 0").select("_file", "_number", "id").toArrow()
    for some in (wanted[:5], pa.concat_tables([wanted] * 5), wanted[:0]):
        found = at_addresses(addressed, some.select(["_file", "_number"]))
        assert sorted(r["id"] for r in found.collect()) == sorted(set(some["id"].to_pylist()))


def test_a_page_reads_the_key_and_then_ten_rows(wide):
    shown = page(wide, ["k"], 3, columns=["id", "w7"])
    (names, text, _, files), = scans_of(shown)
    assert {"id", "w7", "k"} <= names and not names & {"w8", "x", "y"}
    assert "_number" in text or "row_index" in text
    assert files <= 6
    keys_only = page(wide, ["k", "x"], 0, columns=["x"])
    assert all(not names & {"id", "w1"} for names, *_ in scans_of(keys_only))


def test_pages_of_files_hold_each_row_once(wide):
    rows = wide.where("id < 450").select("id", "k", "w2")
    got = [r for n in range(10) for r in page(rows, ["k"], n, 50, ["id", "k", "w2"]).orderBy("row").collect()]
    assert sorted(r["id"] for r in got) == list(range(450))
    assert [r["k"] for r in got] == sorted(i % 977 for i in range(450))
    assert [r["row"] for r in got] == list(range(450)) and all(r["w2"] == 2 * r["id"] for r in got)


def test_a_sample_reads_the_key_first(wide):
    found = scatter_points(wide, "x", "y", "w3", ["id"], limit=500)
    (names, *_), = scans_of(found)
    assert names <= {"id", "x", "y", "w3", "_tmp_metadata_row_index"}
    expected = [r["id"] for r in seeded_shuffle(wide.select("id"), ["id"]).limit(500).collect()]
    assert [r["id"] for r in seeded_sample(wide, ["id"], 500).collect()] == expected
    assert sorted(r["id"] for r in found.collect()) == sorted(expected)
    assert seeded_sample(wide.where("id < 0"), ["id"], 5).count() == 0
    assert seeded_sample(wide, ["id"], ROWS * 2).count() == ROWS
    assert seeded_sample(wide, ["k"], 100).count() == 100


def test_a_stored_shuffle_is_read_at_its_beginning(spark, wide, tmp_path):
    path = str(tmp_path / "sampled")
    write_sampled(wide, path, "pipeline", ["id"], files=4, row_group_bytes=8_000)
    stored = spark.read.parquet(path)
    for rows, limit in ((stored, 25), (stored.where("pipeline = 'odd' and k < 300"), 25), (stored.where("id = 7"), 10)):
        plain = wide if rows is stored else wide.where("pipeline = 'odd' and k < 300") if limit == 25 else wide.where("id = 7")
        expected = [r["id"] for r in seeded_sample(plain, ["id"], limit).collect()]
        assert [r["id"] for r in seeded_sample(rows, ["id"], limit).collect()] == expected
    scans = scans_of(seeded_sample(stored, ["id"], 25))
    assert all("LessThan(_shuffle" in text for _, text, _, _ in scans)
    assert sum(n for _, _, n, _ in scans) <= ROWS * 0.03  # two files, each at least one row group
    # Another seed or key does not take it for its own order.
    assert stored.schema[SHUFFLE].metadata == {"seed": "42", "key": "id"}
    expected = [r["id"] for r in seeded_sample(wide, ["id"], 25, seed=1).collect()]
    assert [r["id"] for r in seeded_sample(stored, ["id"], 25, seed=1).collect()] == expected


def test_a_box_reads_few_row_groups_of_a_clustered_table(spark, wide, tmp_path):
    path = str(tmp_path / "clustered")
    write_clustered(wide, path, "pipeline", ["x", "y"], files=4, row_group_bytes=16_000)
    stored = spark.read.parquet(path)
    assert stored.count() == ROWS and set(stored.columns) == set(wide.columns)
    low, high = wide.approxQuantile("y", [0.5, 0.6], 0.0)
    box = viewport(stored, "x", (50_000, 60_000), "y", (low, high))
    found = stored.where(box).select("id")
    (_, _, read, _), = scans_of(found)
    assert 0.005 * ROWS < found.count() < 0.015 * ROWS
    assert read <= 0.05 * ROWS
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in wide.where(box).select("id").collect())


def test_a_hot_place_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.lit("p").alias("pipeline"), "id", F.when(F.col("id") % 3 > 0, 1.5).otherwise(F.col("id") / 7).alias("x"), F.lit(2.0).alias("y")
    )
    path = tmp_path / "hot"
    write_clustered(rows, str(path), "pipeline", ["x", "y"], files=8)
    counts = spark.read.parquet(str(path)).groupBy(F.input_file_name()).count().agg(F.max("count"), F.count("*")).first()
    assert counts[1] >= 6 and counts[0] < 6_000


def test_parts_of_a_clustered_order(spark):
    rows = [(None, 1.0), (float("nan"), 1.0), *((float(10**i), 1.0) for i in range(-200, 200))]
    df = spark.createDataFrame(rows, "`a.b` double, c double")
    parts = [p.alias(f"p{i}") for i, p in enumerate(cluster_parts(df, ["a.b", "c"]))]
    got = df.select(column("a.b").alias("v"), *parts).collect()
    known = sorted((r["v"], r["p0"]) for r in got if r["v"] is not None and r["v"] == r["v"])
    assert [p for _, p in known] == sorted(p for _, p in known) and len({p for _, p in known}) > 60
    assert {r["p0"] for r in got if r["v"] is None or r["v"] != r["v"]} == {0}
    with pytest.raises(FacetryError):
        write_clustered(df, "nowhere", "c", ["c"])
    with pytest.raises(FacetryError):
        cluster_parts(df.withColumn("t", F.lit("x")), ["t", "c"])


def catalogue_lists(spark, ids):
    return spark.createDataFrame([(str(i),) for i in ids], "value string")


def test_a_long_list_reads_few_row_groups_of_an_ordered_table(spark, wide, tmp_path):
    path = str(tmp_path / "ordered")
    rows = wide.withColumn("t", F.format_string("n%07d", "id"))
    write_ordered(rows, path, "pipeline", ["id"], ["id", "x"], files=4, row_group_bytes=8_000)
    stored = spark.read.parquet(path)
    profile = CatalogProfile(identifiers={"id": "id", "t": "t"}, ordered_identifiers=frozenset({"id", "t"}))
    ids = [*range(100, 1_300), *range(30_000, 30_400), -5, 10**15]
    for kind, values in (("id", ids), ("t", [f"n{i:07d}" for i in ids])):
        test = crossmatch_condition(stored, catalogue_lists(spark, values), kind, "even", profile)
        found = stored.where(test).select("id")
        read = sum(n for names, _, n, _ in scans_of(found) if kind in names)
        assert sorted(r["id"] for r in found.collect()) == sorted(i for i in ids if 0 <= i < ROWS)
        assert read <= 0.2 * ROWS
    nothing = crossmatch_condition(stored, catalogue_lists(spark, [" ", ""]), "id", "even", profile)
    assert stored.where(nothing).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_ranges_hold_the_list(spark, seed):
    r = random.Random(seed)
    ends = [-(2**63), 2**63 - 1] if seed % 2 else []
    ids = sorted({r.randint(-(10 ** r.randint(1, 18)), 10 ** r.randint(1, 18)) for _ in range(300)} | set(ends))
    listed = spark.createDataFrame([(i,) for i in ids], "id bigint")
    ranges = identifier_ranges(listed, listed.schema["id"].dataType)
    assert len(ranges) <= 32 and all(a <= b for a, b in ranges)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert all(any(low <= i <= high for low, high in ranges) for i in ids)


def test_bloom_filters_tell_what_a_row_group_lacks(spark, wide, tmp_path):
    """Values between those of a row group, which its range cannot rule out."""
    path = str(tmp_path / "blooms")
    rows = wide.withColumn("even", F.col("id") * 2)
    write_ordered(rows, path, "pipeline", ["k"], ["even"], files=2, row_group_bytes=64_000)
    stored = spark.read.parquet(path)
    (_, _, read, _), = scans_of(stored.where(F.col("even").isin(10_001, 30_003, 50_005)).select("even", "k"))
    assert read <= 0.2 * ROWS
    (_, _, read, _), = scans_of(stored.where(F.col("even").isin(10_000)).select("even", "k"))
    assert 0 < read < ROWS and stored.where("even = 10000").count() == 1


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    r = random.Random(8)
    words = ["".join(r.choice("abcdeé ñ") for _ in range(r.randint(1, 9))) for _ in range(120)]
    lines = ["\n".join(" ".join(r.choices(words, k=r.randint(0, 8))) for _ in range(r.randint(1, 4))) for _ in range(2_000)]
    rows = [(i, t.upper() if i % 5 == 0 else t) for i, t in enumerate(lines)] + [(5_000, None), (5_001, ""), (5_002, "x" * 9_000)]
    path = tmp_path_factory.mktemp("texts")
    spark.createDataFrame(rows, "id int, t string").repartition(3).write.parquet(str(path / "table"))
    table = spark.read.parquet(str(path / "table"))
    build_text_index(table, "t", str(path / "index"))
    return table, open_text_index(spark, str(path / "index"), "t"), words


def test_an_indexed_search_finds_the_same_rows(texts):
    table, index, words = texts
    r = random.Random(9)
    queries = ["", "a", "xxx", "zzzzz", "ABC", "xxxx xxxx"] + [" ".join(r.choices(words, k=r.randint(1, 3))) for _ in range(14)]
    for query in queries:
        expected = sorted(x["id"] for x in table.where(has_words(F.col("t"), query)).collect())
        found = index.search(table.where("id >= 10"), query)
        assert found.columns == ["id", "t"]
        assert sorted(x["id"] for x in found.collect()) == [i for i in expected if i >= 10]


def test_an_indexed_search_tests_few_rows(texts, monkeypatch):
    table, index, words = texts
    word = max(words, key=lambda w: (" " not in w, len(w)))
    addresses, most = index.candidates(triples_of(word))
    hits = table.where(has_words(F.col("t"), word)).count()
    assert hits <= addresses.count() <= most < table.count() / 4
    monkeypatch.setattr(textindex, "MOST_ADDRESSES", 0)  # longer lists are joined, not collected
    assert index.search(table, word).count() == hits
    with pytest.raises(FacetryError):
        build_text_index(table.groupBy("t").count(), "t", "nowhere")


def test_an_index_lists_blocks_of_rows(texts):
    """One entry for the rows of a block that have a triple, however many these are."""
    table, index, _ = texts
    listed, pairs = {}, 0
    for row in with_address(table).where("t is not null").collect():
        pieces = re.split(r"[ \t\n\x0b\f\r]+", row["t"].lower())
        triples = {piece[i : i + 3] for piece in pieces for i in range(len(piece) - 2)}
        pairs += len(triples)
        for triple in triples:
            key = (triple, row["_place"], row["_number"] // 64)
            listed[key] = listed.get(key, 0) | 1 << row["_number"] % 64
    entries = {(e["triple"], e["_place"], e["_block"]): e["_bits"] % 2**64 for e in index.lists.collect()}
    assert entries == listed and index.lists.count() == len(listed) < pairs / 4
    sizes = {s["triple"]: (s["n"], s["blocks"]) for s in index.sizes.collect()}
    assert sum(n for n, _ in sizes.values()) == pairs and sum(b for _, b in sizes.values()) == len(listed)


def test_an_index_reads_its_texts_once(spark, texts, tmp_path):
    table, _, _ = texts
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    build_text_index(table.select("id", seen("t").alias("t")), "t", str(tmp_path / "index"))
    assert read.value == table.count()


@pytest.mark.parametrize("most", [0, 40])
def test_long_lists_are_joined_by_their_blocks(texts, monkeypatch, most):
    table, index, words = texts
    r = random.Random(10)
    monkeypatch.setattr(textindex, "MOST_ADDRESSES", most)  # 40: more than the blocks of the table, fewer than rows
    for query in [w for w in words if len(w) > 4 and " " not in w][:3] + [" ".join(r.choices(words, k=2)) for _ in range(4)]:
        expected = sorted(x["id"] for x in table.where(has_words(F.col("t"), query)).collect())
        assert sorted(x["id"] for x in index.search(table, query).collect()) == expected


def test_rows_that_are_on_no_list_are_not_tested(texts, monkeypatch):
    table, index, words = texts
    monkeypatch.setattr(textindex, "MOST_ADDRESSES", 0)
    found = index.search(table, next(w for w in words if len(w) > 4 and " " not in w))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in plan.splitlines() if "Contains(" in line]
    assert len(tests) == 1 and "Join LeftSemi" in tests[0]


def test_triples_of_odd_texts(spark):
    cases = ["", "ab", "abc", " abc ", "ab\x0bcde\x0cfg", "a b c de", "x\U0001d4b3y\U0001f600z \U0001f600\U0001f601", "\U0001f600\U0001f601\U0001f602\U0001f603"]
    cases += ["ÀÉÎõ", "aaaaa", "a\x00bc", "éte", "abc\r\nabc ABC", "x" * 70_000]
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, t string").select("id", textindex._triples(F.col("t")).alias("found"))
    for row in rows.collect():
        pieces = re.split(r"[ \t\n\x0b\f\r]+", cases[row["id"]].lower())
        assert sorted(row["found"]) == sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})
