"""Shared folders for intermediate tables.

A long plan is cut by writing a Parquet table to the folder that the session
names in ``spark.checkpoint.dir`` and reading it back: every executor can read
it, and it outlives a lost executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the session names.

    Where it names none, a session of one machine gets a temporary folder; on a
    cluster that would part the data over the machines, so it is an error there.
    """
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{SETTING} is not set: it must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="simloom-")
        spark.conf.set(SETTING, root)
        drop_at_exit(spark, root)
    return root


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Let the file system delete ``path`` when the application ends."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def drop(spark: SparkSession, path: str) -> None:
    """Delete ``path`` now."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder, deleted when the application ends."""
    path = f"{shared_root(spark)}/simloom/{tag}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_written_to"] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that no later plan reads."""
    for table in tables:
        drop(table.sparkSession, table.__dict__["_written_to"])
