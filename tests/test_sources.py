import glob
import json
import time
from datetime import datetime
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest

from facetry.errors import CatalogError, EmptySubsetError, FacetryError
from facetry.functions.expressions import condition
from facetry.operators.binning import histogram
from facetry.plans.subset import SubsetSpec
from facetry.profile import TARGET_FLAGS_COLUMN
from facetry.sources.catalog import (
    Catalog,
    CatalogPaths,
    build_allowed_columns,
    keep,
    materialise,
    open_catalog,
    stack,
    write_catalog,
)
from facetry.sources.exports import Manifest, export_batch, export_name, export_subset, write_subset
from facetry.sources import exports
from facetry.sources.mapping import read_mapping
from facetry.sources.metadata import (
    build_glossary,
    open_glossary,
    read_allowed_columns,
    read_glossary,
    with_metadata,
    write_allowed_columns,
    write_glossary,
)
from facetry.sources.sketches import build_sketches, distinct_from_sketches
from facetry.streaming.counts import count_arrivals
from facetry.streaming.histograms import stream_histogram
from facetry.workspace import CHECKPOINT_DIR, discard, new_folder, shared_root
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def release(spark, stars, mapping, tmp_path_factory):
    """A release on disk: catalogue, mapping, allowed columns and glossary."""
    root = tmp_path_factory.mktemp("releases")
    (root / "dr19").mkdir()
    paths = CatalogPaths(str(root), "0.6.0")
    write_catalog(stars, paths.path("table", "dr19", "star"), "pipeline", ["teff"])
    mapping.coalesce(1).orderBy("bit").drop("bit").write.parquet(paths.path("mapping", "dr19"))
    allowed = {"aspcap": ["ra", "snr", "result_flags", "pipeline", "elsewhere"], "spall": ["ra"]}
    with open(paths.path("allowed", "dr19", "star"), "w") as file:
        json.dump(allowed, file)
    return paths


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_open_catalog(spark, release, stars):
    catalog = open_catalog(spark, release, "DR19", "star")
    assert catalog.table.count() == 30
    assert {r[0] for r in catalog.datasets().collect()} == {"mwmlite", "spall", "aspcap"}
    assert catalog.slice("best").count() == 10
    with pytest.raises(CatalogError, match="no catalogue"):
        open_catalog(spark, release, "dr20", "star")


def test_slice_prunes_partitions_and_columns(spark, release):
    catalog = open_catalog(spark, release, "dr19", "star")
    df = catalog.slice("aspcap")
    plan = plan_of(df.where(condition(df, "teff > 4000 & snr <= 50")).select("ra"))
    assert "PartitionFilters: [isnotnull(pipeline" in plan
    assert "GreaterThan(teff,4000.0)" in plan and "LessThanOrEqual(snr,50.0)" in plan
    assert "ReadSchema: struct<ra:double,snr:float,teff:float>" in plan


def test_metadata(spark, release):
    catalog = with_metadata(spark, open_catalog(spark, release, "dr19", "star"), release)
    assert set(catalog.allowed_columns("aspcap")) == {"ra", "snr", "result_flags", "pipeline"}
    assert set(catalog.export_columns("aspcap")) == {"ra", "snr"}
    assert catalog.export_columns("spall") == ["ra"]
    with pytest.raises(CatalogError, match="no columns"):
        catalog.allowed_columns("thepayne")
    first = catalog.mapping.orderBy("bit").limit(2).collect()
    assert [tuple(r) for r in first] == [(0, "mwm", "carton_0"), (1, "bhm", "carton_1")]


def test_mapping_of_several_files(spark, tmp_path):
    path = tmp_path / "many"
    for file in range(3):
        rows = [(f"m{file}", f"c{file}_{i}") for i in range(4 + file)]
        part = str(tmp_path / f"part{file}")
        spark.createDataFrame(rows, "mapper string, alt_name string").coalesce(1).write.parquet(part)
        path.mkdir(exist_ok=True)
        (tmp_path / f"part{file}").rename(path / f"file={file}")
    bits = [(r["bit"], r["alt_name"]) for r in read_mapping(spark, str(path)).orderBy("bit").collect()]
    names = [f"c{file}_{i}" for file in range(3) for i in range(4 + file)]
    assert bits == list(enumerate(names))
    own = spark.createDataFrame([(7, "m", "c")], "bit int, mapper string, alt_name string")
    own.write.parquet(str(tmp_path / "own"))
    assert [r["bit"] for r in read_mapping(spark, str(tmp_path / "own")).collect()] == [7]


def test_an_empty_or_failed_export_leaves_nothing(spark, tmp_path):
    with pytest.raises(EmptySubsetError):
        write_subset(spark.range(0), str(tmp_path / "empty"))
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        write_subset(bad, str(tmp_path / "bad"))
    assert write_subset(spark.range(3), str(tmp_path / "good")) == 3
    assert [p.name for p in tmp_path.iterdir()] == ["good"]


def test_states_are_written_as_jobs_end(spark, catalog, tmp_path, monkeypatch):
    def job(_, spec, folder, identifiers=None):
        if spec.name == "slow":
            time.sleep(4)
        if spec.name == "mute":
            raise ValueError
        return folder, 1

    monkeypatch.setattr(exports, "export_subset", job)
    manifest = Manifest(spark, str(tmp_path / "manifest"))
    specs = [SubsetSpec(name=n, dataset="aspcap", flags=()) for n in ("slow", "quick", "mute")]
    export_batch(catalog, specs, str(tmp_path), manifest)
    last = {r["name"]: r for r in manifest.read().collect()}
    assert last["quick"]["updated"] < last["slow"]["updated"]
    assert (last["mute"]["status"], last["mute"]["message"]) == ("failed", "ValueError")


def test_a_stream_goes_on_in_its_folder(spark, tmp_path):
    table, folder = str(tmp_path / "table"), str(tmp_path / "state")
    for n in (5, 3):
        spark.range(n).select(F.lit("k").alias("key"), "id").write.mode("append").parquet(table)
        stream = spark.readStream.schema("key string, id bigint").parquet(table)
        total = count_arrivals(stream, F.col("id") >= 0, "key", folder).collect()
    assert [(r["key"], r["n"]) for r in total] == [("k", 8)]


def test_stack_and_allowed_columns(spark):
    a = spark.createDataFrame([(1, 1.0, float("nan")), (2, None, float("nan"))], "id int, x double, y double")
    b = spark.createDataFrame([(3, "t")], "id int, name string")
    table = stack({"a": a, "b": b}, "pipeline")
    assert sorted(table.columns) == ["id", "name", "pipeline", "x", "y"] and table.count() == 3
    allowed = build_allowed_columns(table, "pipeline")
    assert {tuple(r) for r in allowed.collect()} == {("a", "id"), ("a", "x"), ("b", "id"), ("b", "name")}


def test_allowed_columns_survive_the_file(spark, tmp_path):
    allowed = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "dataset string, column string")
    path = str(tmp_path / "allowed")
    write_allowed_columns(allowed, path)
    assert {tuple(r) for r in read_allowed_columns(spark, path).collect()} == {("a", "x"), ("a", "y"), ("b", "x")}


def test_glossary(spark, tmp_path):
    products = spark.createDataFrame(
        [
            ("dr19", 1, "teff", "old", "float", "K"),
            ("dr19", 2, "teff", "new", "double", "K"),
            ("dr19", 1, "logg", "gravity", "float", None),
            ("dr18", 3, "teff", "other release", "float", "K"),
        ],
        "release string, product_no int, name string, description string, type string, unit string",
    )
    built = build_glossary(products, "dr19")
    expected = {("teff", "new", "double", "K"), ("logg", "gravity", "float", None)}
    assert {tuple(r) for r in built.collect()} == expected
    path = str(tmp_path / "glossary")
    write_glossary(built, path)
    assert {tuple(r) for r in read_glossary(spark, path).collect()} == expected
    paths = CatalogPaths(str(tmp_path), glossary="{root}/{release}")
    write_glossary(built, paths.path("glossary", "DR19"))
    assert {tuple(r) for r in open_glossary(spark, paths).collect()} == expected


def test_many_entries_are_written_in_parallel(spark, tmp_path):
    glossary = spark.range(200_000).select(
        F.concat(F.lit("n"), "id").alias("name"), *[F.lit(x).alias(x) for x in ("description", "type", "unit")]
    )
    write_glossary(glossary, str(tmp_path / "glossary"))
    read = read_glossary(spark, str(tmp_path / "glossary"))
    assert read.count() == 200_000 and read.select("name").distinct().count() == 200_000


def test_one_object_over_many_lines(spark, tmp_path):
    entry = {"name": "a", "description": "d", "type": "t", "unit": "u"}
    (tmp_path / "one.json").write_text(json.dumps({"a": entry, "b": entry | {"name": "b"}}, indent=1))
    assert sorted(r["name"] for r in read_glossary(spark, str(tmp_path / "one.json")).collect()) == ["a", "b"]


def test_keep(stars):
    kept = keep(stars.where("ra > 10").select("ra"))
    assert kept.storageLevel.useMemory and kept.storageLevel.useDisk and kept.count() == 29
    kept.unpersist()


def test_materialise(spark, stars):
    written = materialise(stars.where("ra > 10"))
    assert written.schema == stars.schema and written.count() == 29
    assert spark.conf.get(CHECKPOINT_DIR) in written.inputFiles()[0]


def test_batch_with_kept_slices(spark, catalog, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "manifest"))
    specs = [SubsetSpec(name=n, dataset="aspcap", flags=(), expression=e) for n, e in (("a", "ra > 100"), ("b", ""))]
    export_batch(catalog, specs, str(tmp_path / "out"), manifest, keep_slices=True)
    assert {r["name"]: r["n_rows"] for r in manifest.read().collect()} == {"a": 7, "b": 10}
    assert not catalog.slice("aspcap").storageLevel.useMemory


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get(CHECKPOINT_DIR)
    assert new_folder(spark, "x").startswith(spark.conf.get(CHECKPOINT_DIR) + "/facetry/x-")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_no_machine_local_folder_on_a_cluster():
    def session(master, checkpoint=None):
        context = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: checkpoint)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    with pytest.raises(FacetryError, match=CHECKPOINT_DIR):
        shared_root(session("spark://host:7077"))
    assert shared_root(session("spark://host:7077", "hdfs://x/checkpoints/")) == "hdfs://x/checkpoints"
    assert shared_root(session("local[2]")) == shared_root(session("local[2]"))


# Exports ----------------------------------------------------------------------------------------


def test_chunks_are_row_groups(spark, tmp_path):
    path = str(tmp_path / "rows")
    assert write_subset(spark.range(0, 2500, numPartitions=1), path, chunk_rows=1000) == 2500
    files = glob.glob(f"{path}/*.parquet")
    metadata = pq.ParquetFile(files[0]).metadata
    assert len(files) == 1 and metadata.num_rows == 2500
    assert max(metadata.row_group(i).num_rows for i in range(metadata.num_row_groups)) <= 1000


def test_export(spark, catalog, rows, tmp_path):
    spec = SubsetSpec(name="x", dataset="aspcap", expression="ra > 100", flags=(), computed=(("twice", "ra * 2"),))
    path, n_rows = export_subset(catalog, spec, str(tmp_path))
    written = spark.read.parquet(path)
    expected = [r["ra"] for r in rows if r["pipeline"] == "aspcap" and r["ra"] > 100]
    assert n_rows == len(expected)
    assert sorted(r["ra"] for r in written.collect()) == expected
    assert "twice" in written.columns and "pipeline" not in written.columns
    assert TARGET_FLAGS_COLUMN not in written.columns and "result_flags" not in written.columns
    assert path.startswith(f"{tmp_path}/subset-x-dr19-star-aspcap-") and ":" not in path


def test_export_of_nothing(catalog, tmp_path):
    with pytest.raises(EmptySubsetError):
        export_subset(catalog, SubsetSpec(dataset="aspcap", expression="ra < -1", flags=()), str(tmp_path))


def test_export_name():
    name = export_name(SubsetSpec(name="A", dataset="spall"), "dr19", "star", datetime(2025, 1, 2, 3, 4, 5))
    assert name == "subset-A-dr19-star-spall-2025-01-02_03-04-05.parquet"


def test_batch_and_manifest(spark, catalog, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "manifest"))
    specs = [
        SubsetSpec(name="good", dataset="aspcap", flags=()),
        SubsetSpec(name="bad text", dataset="aspcap", expression="nothing > 1"),
        SubsetSpec(name="late error", dataset="aspcap", flags=(), crossmatch="1\n2x"),
        SubsetSpec(name="empty", dataset="aspcap", flags=(), expression="ra < -1"),
        SubsetSpec(name="twin", dataset="aspcap", flags=()),
    ]
    uids = export_batch(catalog, specs, str(tmp_path / "out"), manifest)
    jobs = {r["uid"]: r for r in manifest.read().collect()}
    assert list(jobs.keys()) != [] and set(jobs) == set(uids)
    state = {r["name"]: (r["status"], r["n_rows"]) for r in jobs.values()}
    assert state == {
        "good": ("complete", 10),
        "bad text": ("failed", None),
        "late error": ("failed", None),
        "empty": ("failed", None),
        "twin": ("complete", 10),
    }
    for row in jobs.values():
        if row["status"] == "complete":
            assert row["uid"] in row["filepath"] and spark.read.parquet(row["filepath"]).count() == 10
        else:
            assert row["message"] and row["filepath"] is None
    history = spark.read.parquet(manifest.path).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in history} == {"in_progress": 5, "complete": 2, "failed": 3}


# Plans and streams ------------------------------------------------------------------------------


def test_whole_subset_plan(spark, release):
    catalog = with_metadata(spark, open_catalog(spark, release, "dr19", "star"), release)
    spec = SubsetSpec(
        dataset="aspcap",
        expression="teff > 4000",
        flags=("snr > 50",),
        cartons=("carton_3",),
        mappers=("mwm",),
        crossmatch="\n".join(map(str, range(2000))),
    )
    plan = plan_of(spec.compile(catalog).select("ra"))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "PartitionFilters: [isnotnull(pipeline" in plan
    for word in ("Python", "CartesianProduct", "NestedLoop", "zip_with", "lambda"):
        assert word not in plan


def test_stream_counts_equal_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    test = condition(events, "value > 20 & event_type != 'click'")
    counted = {r["event_type"]: r["n"] for r in count_arrivals(stream, test, "event_type").collect()}
    expected = events.where(test).groupBy("event_type").agg(F.count("*").alias("n")).collect()
    assert counted == {r["event_type"]: r["n"] for r in expected}


def test_catalog_without_allowed_list(stars):
    assert Catalog(stars).allowed_columns("aspcap") == stars.columns
    with pytest.raises(FacetryError):
        SubsetSpec(dataset="aspcap", flags=("unknown",)).compile(Catalog(stars))


GLOSSARY = """{
  "teff":
  {
    "name": "teff", "description": "a } {b} of
 braces", "type": "float", "unit": "K"
  },
  "logg": {"name": "logg", "description": "d", "type": "float", "unit": null}
}
"""


@pytest.mark.parametrize("layout", ["braces on lines", "one line", "lines", "objects that follow each other"])
def test_json_objects_of_any_layout(spark, tmp_path, layout):
    entries = [("teff", "a } {b} of braces"), ("logg", "d")]
    objects = [json.dumps({n: {"name": n, "description": d, "type": "float", "unit": "K"}}) for n, d in entries]
    text = {
        "braces on lines": GLOSSARY.replace("of\n braces", "of braces"),
        "one line": objects[0][:-1] + ", " + objects[1][1:],
        "lines": "\n".join(objects) + "\n\n",
        "objects that follow each other": "\n  \n".join(json.dumps(json.loads(o), indent=2) for o in objects),
    }[layout]
    path = tmp_path / "glossary.json"
    path.write_text(text)
    assert {(r["name"], r["description"]) for r in read_glossary(spark, str(path)).collect()} == set(entries)


@pytest.mark.parametrize("text", ["{", "[1]", '{"a": {"name": "x"}', '{"a": 1} x', "nothing"])
def test_what_is_no_object_is_an_error(spark, tmp_path, text):
    path = tmp_path / "glossary.json"
    path.write_text(text)
    with pytest.raises(Exception, match="JSON|json|cast|schema|Malformed"):
        read_glossary(spark, str(path)).collect()


def test_only_own_tables_are_discarded(spark, tmp_path):
    own = str(tmp_path / "own")
    spark.range(5).write.parquet(own)
    first, second = materialise(spark.range(3)), materialise(spark.range(4))
    assert discard(first.unionAll(spark.read.parquet(own))) == 1
    assert second.count() == 4 and spark.read.parquet(own).count() == 5
    assert discard(second) == 1 and discard(spark.range(3)) == 0
    with pytest.raises(Exception):
        first.count()


def test_sketches_of_slices_merge(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 15_000, "hot").otherwise("cold").alias("p"),
        (F.col("id") % 4_000).alias("a"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise((F.col("id") % 70).cast("double")).alias("b"),
        F.lit(None).cast("string").alias("none"),
    )
    sketches = build_sketches(rows, "p")
    assert {(r["dataset"], r["column"], r["n_rows"]) for r in sketches.collect()} == {
        (p, c, n) for p, n in (("hot", 15_000), ("cold", 5_000)) for c in ("a", "b", "none")
    }
    for name, datasets, exact, values in (
        ("a", None, 4000, 20_000), ("b", None, 35, 10_000), ("b", ["cold"], 35, 2500), ("none", ["hot", "cold"], 0, 0)
    ):
        found = distinct_from_sketches(sketches, name, datasets).first()
        assert abs(found["n_distinct"] - exact) <= 0.03 * exact and found["n_values"] == values
    with pytest.raises(Exception, match="no sketch"):
        distinct_from_sketches(sketches, "unknown").collect()


def test_a_stream_histogram_keeps_its_counts(spark, tmp_path):
    """New files change the counts, rows that come again do not, and a second call goes on with the state."""
    table, folder = str(tmp_path / "table"), str(tmp_path / "state")
    schema = "key bigint, ts timestamp, v double"
    expected = {}
    for part in range(3):
        rows = [(part * 100 + i, datetime(2024, 1, 1 + part, i % 24), float(i)) for i in range(50)]
        again = [(k, t, v) for k, t, v in rows[:20]]
        odd = [(900 + part, datetime(2024, 1, 1 + part), x) for x in (float("nan"), None, -5.0, 1e9)][part : part + 1]
        spark.createDataFrame(rows + again + odd, schema).write.mode("append").parquet(table)
        stream = spark.readStream.schema(schema).parquet(table)
        got = stream_histogram(stream, "v", (0, 49), "ts", ["key"], bins=7, delay="30 days", folder=folder)
        for _, _, v in rows:
            b = min(int(v / 49 * 7), 6)
            expected[b] = expected.get(b, 0) + 1
        assert {r["x_bin"]: r["n"] for r in got.collect()} == expected
    batch = histogram(spark.createDataFrame([(float(i),) for i in range(50)], "v double"), "v", 7, (0, 49))
    assert {(r["x_bin"], r["x"]) for r in got.collect()} == {(r["x_bin"], r["x"]) for r in batch.collect()}
