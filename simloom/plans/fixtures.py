"""The tables that the queries work on, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize, new_path
from simloom.operators import graph, mining, pairs, search

__all__ = ["materialize", "new_path"]

#: Distances under which two vectors are linked as DUPLICATE, and between which as POSITIVE.
DUPLICATE, POSITIVE = 0.58, 0.62
#: Length of the result lists that are evaluated.
DEPTH = 400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(uid, features)."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("features"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """(uid, class_id)."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), F.col("label").alias("class_id"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """(uid, features, class_id)."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("features"), F.col("label").alias("class_id"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(img1, img2, type, dist) of near vectors."""
    kind = F.when(F.col("dist") < DUPLICATE, graph.DUPLICATE).otherwise(graph.POSITIVE)
    return materialize(pairs.within(vectors(spark, sf), POSITIVE).select(F.col("i").alias("img1"), F.col("j").alias("img2"), kind.alias("type"), "dist"), "links")


def maps(spark: SparkSession, sf: str, relu: bool = True) -> DataFrame:
    """(uid, h, w, c, data): each vector as a map of 4 x 4 cells and 4 channels."""
    data = F.col("embedding").cast("array<double>")
    if relu:
        data = F.transform(data, lambda x: F.greatest(x, F.lit(0.0)))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.lit(4).alias("c"), data.alias("data"))


def asked(spark: SparkSession, sf: str, graph_links: DataFrame) -> DataFrame:
    """(query_id, features) of each node with a POSITIVE link."""
    nodes = graph.benchmark_targets(graph_links).select("query_id").distinct()
    rows = vectors(spark, sf)
    return rows.join(nodes, rows["uid"] == nodes["query_id"]).select("query_id", "features")


def results(spark: SparkSession, sf: str, graph_links: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, rank, uid, score) of the search for each node with a POSITIVE link."""
    return materialize(search.search_many(vectors(spark, sf), asked(spark, sf, graph_links), depth), "results")


def placed(spark: SparkSession, sf: str, graph_links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uid, features, component) of all rows, the same of nodes with a POSITIVE link with query_id, and the pairs of components that ignore each other."""
    known, groups = graph.ignored_groups(graph_links)
    rows = vectors(spark, sf).join(known, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    return rows.drop("asked"), rows.where("asked").select(F.col("uid").alias("query_id"), "features", "component"), groups


def marked_results(spark: SparkSession, sf: str, graph_links: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``results`` with ``skipped``: whether ``graph.ignore_closure`` has the row."""
    rows, queries, groups = placed(spark, sf, graph_links)
    return materialize(search.search_many(rows, queries, depth, groups), "results")


def triplet_results(spark: SparkSession, sf: str, graph_links: DataFrame, quota: int) -> DataFrame:
    """The same, each node searched as deep as the rows that it ignores ask for, and to ``DEPTH`` at least."""
    rows = vectors(spark, sf)
    asked = mining.triplet_depth(graph_links, quota, DEPTH)
    queries = rows.join(asked, rows["uid"] == asked["query_id"]).select("query_id", "features", "depth")
    return materialize(search.search_many(rows, queries), "results")


def fair_results(spark: SparkSession, sf: str, graph_links: DataFrame, quota: int) -> DataFrame:
    """``triplet_results`` with ``skipped``, without the ignored rows that are no targets: in a large component nearly all rows are ignored."""
    rows, queries, groups = placed(spark, sf, graph_links)
    depth = mining.triplet_depth(graph_links, quota, DEPTH)
    return materialize(search.search_many(rows, queries.join(depth, "query_id"), None, groups, graph.benchmark_targets(graph_links)), "results")
