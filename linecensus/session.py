"""Session helpers: shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a cluster the folder
    must be one that every executor sees, so its absence is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="linecensus-")
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/linecensus/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Remove everything that runs have left in the shared folder; results read from it are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/linecensus")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and continue from the files: later stages re-read, they never recompute."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def posix_path(path: str) -> str:
    """Plain path of a local or mounted folder (file: URIs allowed; a colon alone makes no URI)."""
    if re.match("file:/", path):
        return os.path.abspath(urlparse(path).path)
    if re.match("[A-Za-z][A-Za-z0-9+.-]*://", path):
        raise ValueError(f"{path}: file trees are read through a mounted path")
    return path
