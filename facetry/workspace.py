"""Folders for tables that jobs write between stages.

They lie in the folder the cluster shares with all executors (``spark.checkpoint.dir``), so that a
lost executor never takes an intermediate table with it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from facetry.errors import FacetryError

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local session without one gets a folder of its own."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise FacetryError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return _local_root(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"facetry-{application}-")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_root(spark)}/facetry/{purpose}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> int:
    """Delete the tables of the shared folder that ``df`` reads; returns how many there were.

    Only what ``new_folder`` named is deleted, never a table of the user. The frame cannot be read afterwards.
    """
    spark = df.sparkSession
    names = re.compile(rf"(.*{re.escape(shared_root(spark).split(':')[-1])}/facetry/[^/]+-[0-9a-f]{{32}})/")
    folders = {found[1] for found in map(names.match, df.inputFiles()) if found}
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)
