"""Tables about columns: the columns allowed per dataset, and the glossary of column names.

Both are published as one JSON object, or as lines of JSON objects with the same entries, in one file or many;
they are written as lines, in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.profile import DEFAULT_RELEASE
from facetry.sources.catalog import Catalog, CatalogPaths
from facetry.sources.mapping import read_mapping

ALLOWED_TYPE = "map<string, array<string>>"
GLOSSARY_TYPE = "map<string, struct<name: string, description: string, type: string, unit: string>>"
BETWEEN_OBJECTS = r"(?<=\})[ \t\r]*\n\s*(?=\{)"


def _read_object(spark: SparkSession, path: str, kind: str) -> DataFrame:
    # Objects that follow each other have nothing but a line break between their braces; inside an object a comma or a
    # colon stands there, and a text holds no line break.
    texts = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", BETWEEN_OBJECTS)).alias("value"))
    item = F.from_json("value", kind)
    wrong = F.raise_error(F.concat(F.lit("no JSON object of the expected kind: "), F.substring("value", 1, 80)))
    found = texts.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select(F.coalesce(item, wrong.cast(kind)).alias("m"))
    return found.select(F.explode("m").alias("key", "item"))


def _write_object(pairs: DataFrame, path: str) -> None:
    """Write ``(key, item)`` rows as lines of JSON objects with one entry each."""
    pairs.select(F.to_json(F.create_map("key", "item")).alias("value")).write.text(path)


def read_allowed_columns(spark: SparkSession, path: str) -> DataFrame:
    """``(dataset, column)`` of a JSON object that lists the columns of each dataset."""
    return _read_object(spark, path, ALLOWED_TYPE).select(
        F.col("key").alias("dataset"), F.explode("item").alias("column")
    )


def write_allowed_columns(allowed: DataFrame, path: str) -> None:
    lists = allowed.groupBy(F.col("dataset").alias("key")).agg(F.sort_array(F.collect_set("column")).alias("item"))
    _write_object(lists, path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """``(name, description, type, unit)`` of a JSON object of column descriptions."""
    return _read_object(spark, path, GLOSSARY_TYPE).select("item.*")


def open_glossary(spark: SparkSession, paths: CatalogPaths, release: str = DEFAULT_RELEASE) -> DataFrame:
    return read_glossary(spark, paths.path("glossary", release))


def write_glossary(glossary: DataFrame, path: str) -> None:
    entry = F.struct("name", "description", "type", "unit")
    _write_object(glossary.select(F.col("name").alias("key"), entry.alias("item")), path)


def build_glossary(products: DataFrame, release: str, order: Sequence[str] = ("product_no",)) -> DataFrame:
    """One description per column name out of many products of a release; the last product wins.

    ``products`` has the release, the order columns and the four glossary columns.  The winner is an
    aggregate, so a name that occurs in most rows is reduced before the shuffle.
    """
    entry = F.struct("description", "type", "unit")
    winners = (
        products.where(F.col("release") == release)
        .groupBy("name")
        .agg(F.max_by(entry, F.struct(*order)).alias("entry"))
    )
    return winners.select("name", "entry.*")


def with_metadata(spark: SparkSession, catalog: Catalog, paths: CatalogPaths) -> Catalog:
    """The catalogue with its mapping and its allowed columns."""
    return Catalog(
        catalog.table,
        catalog.profile,
        read_mapping(spark, paths.path("mapping", catalog.release)),
        read_allowed_columns(spark, paths.path("allowed", catalog.release, catalog.datatype)),
        catalog.release,
        catalog.datatype,
    )
