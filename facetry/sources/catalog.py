"""Catalogues: one Parquet table per release and datatype, holding the rows of all pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from facetry.errors import CatalogError
from facetry.functions.missing import column, is_missing
from facetry.profile import CatalogProfile
from facetry.workspace import new_folder


@dataclass(frozen=True)
class CatalogPaths:
    """Where the files of a release lie; the templates are filled with release, datatype and version."""

    root: str
    version: str = ""
    table: str = "{root}/{release}/{datatype}-{version}.parquet"
    mapping: str = "{root}/{release}/mappings.parquet"
    allowed: str = "{root}/{release}/columns-{datatype}-{version}.json"
    glossary: str = "{root}/{release}/glossary.json"

    def path(self, kind: str, release: str, datatype: str = "") -> str:
        template = getattr(self, kind)
        return template.format(root=self.root, release=release.lower(), datatype=datatype, version=self.version)


@dataclass(frozen=True)
class Catalog:
    """An open catalogue and the tables that go with it.

    ``table`` holds every pipeline; ``mapping`` and ``allowed`` are needed for targeting conditions and
    for exports only.
    """

    table: DataFrame
    profile: CatalogProfile = field(default_factory=CatalogProfile)
    mapping: DataFrame | None = None
    allowed: DataFrame | None = None
    release: str = ""
    datatype: str = "star"

    def slice(self, dataset: str) -> DataFrame:
        """The rows of one pipeline: a partition filter when the table is partitioned by it."""
        return self.table.where(column(self.profile.pipeline) == self.profile.dataset(dataset))

    def datasets(self) -> DataFrame:
        return self.table.select(column(self.profile.pipeline)).distinct()

    def allowed_columns(self, dataset: str) -> list[str]:
        """The columns of a dataset that hold values, in the order of the table."""
        if self.allowed is None:
            return list(self.table.columns)
        rows = self.allowed.where(F.col("dataset") == self.profile.dataset(dataset)).select("column").distinct()
        # At most one row per column of the table.
        names = {r["column"] for r in rows.where(F.col("column").isin(self.table.columns)).collect()}
        if not names:
            raise CatalogError(f"no columns are listed for dataset {dataset!r}")
        return [c for c in self.table.columns if c in names]

    def export_columns(self, dataset: str) -> list[str]:
        """The allowed columns without the pipeline and without bit flags."""
        return [c for c in self.allowed_columns(dataset) if c != self.profile.pipeline and "_flags" not in c]


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a path that does not exist is an error a user can read."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise CatalogError(f"there is no catalogue at {path}") from error


def open_catalog(
    spark: SparkSession,
    paths: CatalogPaths,
    release: str,
    datatype: str = "star",
    profile: CatalogProfile | None = None,
) -> Catalog:
    """The catalogue of a release; tables that go with it are attached by ``with_metadata``."""
    table = open_table(spark, paths.path("table", release, datatype))
    return Catalog(table, profile or CatalogProfile(), release=release.lower(), datatype=datatype)


def keep(df: DataFrame) -> DataFrame:
    """Hold a slice that several views share; what memory cannot hold goes to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def materialise(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: a slice that no lost executor takes along."""
    path = new_folder(df.sparkSession, "slice")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stack(products: Mapping[str, DataFrame], pipeline: str) -> DataFrame:
    """One table of the summary tables of all pipelines; columns a pipeline lacks are NULL."""
    named = [df.withColumn(pipeline, F.lit(name)) for name, df in products.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def write_catalog(df: DataFrame, path: str, pipeline: str, sort_by: Sequence[str] = ()) -> None:
    """Write a catalogue partitioned by pipeline.

    Rebalancing gives files of an even size and splits a pipeline that holds most of the rows over many
    tasks.  Rows sorted by a column that is often compared let the reader skip row groups.
    """
    even = df.hint("rebalance", F.col(pipeline))
    if sort_by:
        even = even.sortWithinPartitions(pipeline, *sort_by)
    even.write.partitionBy(pipeline).parquet(path)


def build_allowed_columns(df: DataFrame, pipeline: str) -> DataFrame:
    """``(dataset, column)`` of the columns that are not all missing in a pipeline, in one pass."""
    names = [c for c in df.columns if c != pipeline]
    held = df.groupBy(column(pipeline).alias("dataset")).agg(
        *[F.max(~is_missing(df, n)).alias(f"c{i}") for i, n in enumerate(names)]
    )
    rows = [F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("held")) for i, n in enumerate(names)]
    return held.select("dataset", F.inline(F.array(*rows))).where("held").select("dataset", "column")
