"""Folders of the file system a path belongs to, through Spark's own Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _open(spark, path)
    return system.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none where it does not exist."""
    at, system = _open(spark, path)
    if not system.exists(at):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory())


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all below it; False where there is none."""
    at, system = _open(spark, path)
    return system.delete(at, True)
