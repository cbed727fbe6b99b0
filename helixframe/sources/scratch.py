"""Folders for intermediate files that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session, whose driver and executors are one process, may name
    none and gets a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else ""
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder, deleted when the application ends if ``discard`` has not done it before."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    where, at = _hadoop(spark, path)
    # A file system forgets paths that aren't there when they are named.
    where.mkdirs(at)
    where.deleteOnExit(at)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete what no later plan reads."""
    for path in paths:
        where, at = _hadoop(spark, path)
        where.delete(at, True)
