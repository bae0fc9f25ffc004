"""Readers and writers of the flat files that the engine exchanges, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATHS = "uid string, path string"
ITEMS = "class_id int, path string, uid string"
CLASSES = "class_id int, class_name string, count long"
TRIPLETS = "path1 string, path2 string, path3 string"
PAIRS = "path1 string, path2 string, label double"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, tabs: bool = False) -> DataFrame:
    """A CSV or TSV table."""
    return spark.read.csv(path, schema=schema, header=header, sep="\t" if tabs else ",")


def write_csv(rows: DataFrame, path: str, header: bool = True, tabs: bool = False) -> None:
    """A CSV or TSV table in a folder that must not exist."""
    rows.write.csv(path, header=header, sep="\t" if tabs else ",")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of JSON lines."""
    return spark.read.json(path, schema=schema)


def write_json(rows: DataFrame, path: str) -> None:
    """A table of JSON lines in a folder that must not exist."""
    rows.write.json(path)


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(uid, path): the files of a pattern by name; their contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select(F.element_at(F.split("path", "/"), -1).alias("uid"), "path")


def export_examples(examples: DataFrame, paths: DataFrame, path: str, columns: list[str]) -> None:
    """Write examples without header, ids replaced by paths; the other columns stay."""
    out = examples
    for c in columns:
        out = out.join(paths.select(F.col("uid").alias(c), F.col("path").alias(f"_{c}")), c).withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    write_csv(out.select(*examples.columns), path, header=False)


def missing_keys(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (a, b) whose key least_greatest is not among ``done`` (key)."""
    keyed = pairs.withColumn("key", F.concat_ws("_", F.least("a", "b"), F.greatest("a", "b")))
    return keyed.join(done.select("key"), "key", "left_anti")


def from_split_codes(rows: DataFrame) -> DataFrame:
    """(uid, class_id, split) of (path, author, code): codes 1, 2, 3 are train, validation, test; classes count from 0; the uid is the file stem."""
    from simloom.functions.text import file_stem

    split = F.when(F.col("code") == 1, "train").when(F.col("code") == 2, "validation").when(F.col("code") == 3, "test")
    return rows.select(file_stem(F.col("path")).alias("uid"), (F.col("author") - 1).alias("class_id"), split.alias("split"))
