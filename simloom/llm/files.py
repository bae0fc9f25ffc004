"""Files that tasks write and read themselves, in any file system that Arrow knows."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host of its file system; without a scheme, that of the session's default one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toString()


def open_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith(("s3a://", "s3n://")):  # Hadoop's names of what Arrow calls s3
        path = "s3" + path[3:]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path
