"""Exports of subsets to Parquet, one by one or in batches with a manifest."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.errors import EmptySubsetError, FacetryError
from facetry.functions.missing import column
from facetry.plans.subset import SubsetSpec
from facetry.sources.catalog import Catalog, keep

# Rows of one chunk (a Parquet row group), states of a job.
CHUNK_ROWS = 60_000
IN_PROGRESS, COMPLETE, FAILED = "in_progress", "complete", "failed"

REBALANCED_BYTES = 8 << 30

MANIFEST_SCHEMA = (
    "uid string, name string, status string, message string, filepath string, n_rows bigint, updated timestamp"
)


def export_name(spec: SubsetSpec, release: str, datatype: str, when: datetime) -> str:
    # Fixed value: the form of the name, but for the time, in which file systems forbid colons.
    stamp = when.strftime("%Y-%m-%d_%H-%M-%S")
    return f"subset-{spec.name}-{release}-{datatype}-{spec.dataset}-{stamp}.parquet"


def write_subset(rows: DataFrame, path: str, chunk_rows: int = CHUNK_ROWS) -> int:
    """Write rows in chunks and return how many a reader will find; no rows is an error.

    The count comes from the footers of the written files, so the subset is computed once only.  The files lie
    under a hidden name until they are complete; an empty or failed export leaves nothing.
    """
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/_{name}"
    fs, at = _file_system(rows.sparkSession, hidden)
    try:
        _even_files(rows).write.option("parquet.block.row.count.limit", chunk_rows).parquet(hidden)
        written = rows.sparkSession.read.schema(rows.schema).parquet(hidden).count()
        if written == 0:
            raise EmptySubsetError("the subset has no rows to export")
        if not fs.rename(at, _file_system(rows.sparkSession, path)[1]):
            raise FacetryError(f"cannot rename the finished export to {path}")
    except BaseException:
        fs.delete(at, True)
        raise
    return written


def _even_files(rows: DataFrame) -> DataFrame:
    """Rows dealt anew into files of an even size, where the table they come from is small.

    A selective subset of a small table would else leave one small file per task.  A large one is written where
    it is read, without a shuffle.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.hint("rebalance") if size <= REBALANCED_BYTES else rows


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def export_subset(
    catalog: Catalog, spec: SubsetSpec, folder: str, identifiers: DataFrame | None = None
) -> tuple[str, int]:
    """Write the allowed and the computed columns of a subset; returns the path and the row count."""
    spec = spec.with_defaults(catalog.profile, catalog.datatype)
    rows = spec.compile(catalog, identifiers)
    names = catalog.export_columns(spec.dataset) + [n for n, _ in spec.computed]
    name = export_name(spec, catalog.release, catalog.datatype, datetime.now(timezone.utc))
    path = f"{folder.rstrip('/')}/{name}"
    return path, write_subset(rows.select(*map(column, names)), path)


@dataclass(frozen=True)
class Manifest:
    """A table of job states that any session can read; each change of state is one more row."""

    spark: SparkSession
    path: str

    def append(self, rows: Sequence[tuple]) -> None:
        now = datetime.now(timezone.utc)
        table = self.spark.createDataFrame([(*row, now) for row in rows], MANIFEST_SCHEMA)
        table.coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """The latest state of each job."""
        rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(self.path)
        last = Window.partitionBy("uid").orderBy(F.desc("updated"), F.desc(F.col("status") != IN_PROGRESS))
        ranked = rows.withColumn("nth", F.row_number().over(last))
        return ranked.where(F.col("nth") == 1).drop("nth")


def export_batch(
    catalog: Catalog,
    specs: Sequence[SubsetSpec],
    folder: str,
    manifest: Manifest,
    workers: int = 2,
    keep_slices: bool = False,
) -> list[str]:
    """Export several subsets; one that fails does not stop the rest.  Returns the job ids.

    Jobs run side by side on the session, so that a small export fills the slots a large one leaves.
    ``keep_slices`` holds each dataset that several exports need until the batch is done; without it
    every export reads the columns and partitions it needs, which is better for slices of many columns.
    """
    jobs = {uuid.uuid4().hex: spec.with_defaults(catalog.profile, catalog.datatype) for spec in specs}
    manifest.append([(uid, s.name, IN_PROGRESS, "", None, None) for uid, s in jobs.items()])

    def run(uid: str, spec: SubsetSpec) -> tuple:
        try:
            path, n_rows = export_subset(catalog, spec, f"{folder.rstrip('/')}/{uid}")
        except Exception as error:  # whatever ends one job must not end the others
            lines = str(error).strip().splitlines() or [type(error).__name__]
            return uid, spec.name, FAILED, lines[0], None, None
        return uid, spec.name, COMPLETE, "", path, n_rows

    uses = Counter(spec.dataset for spec in jobs.values())
    kept = [keep(catalog.slice(d)) for d, n in uses.items() if n > 1] if keep_slices else []
    target = inheritable_thread_target(catalog.table.sparkSession)(run)
    with ThreadPoolExecutor(max_workers=workers) as pool:
        for done in as_completed([pool.submit(target, uid, spec) for uid, spec in jobs.items()]):
            manifest.append([done.result()])
    for held in kept:
        held.unpersist()
    return list(jobs)
