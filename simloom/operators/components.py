"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each endpoint of an edge is connected with.

    Alternates two steps until the edges are stars: each node links its
    larger neighbours to its least one, then itself and its smaller neighbours
    to the least. Edges are stars once every node has at most one smaller
    neighbour, and that one has none; counting this takes one shuffle of partial
    sums, far less than a further round. The number of edges never grows, no step gathers the
    neighbours of a node (a window over them only takes their minimum), and a
    few rounds suffice even for long chains. Each round is written to the
    shared folder, which cuts the lineage. Loops and repeated edges are
    harmless; rows with a null end are left out.
    """
    x, y = F.col(a), F.col(b)
    nodes = edges.where(x.isNotNull() & y.isNotNull()).select(x.alias("u"), y.alias("v"))
    now = nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    rounds = 0
    while not _are_stars(now):
        if (rounds := rounds + 1) > most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        after = small.select("u", "v").unionByName(small.select(F.col("w").alias("u"), "v")).where("u <> v").distinct()
        last, now = now, materialize(after, "edges")
        release(last)
    every = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return every.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node is the larger end ``u`` of two edges, or of one and the smaller end ``v`` of another. No edge repeats."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("larger"), F.lit(0).alias("smaller"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("larger"), F.lit(1).alias("smaller")))
    return ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller")).where("larger > 1 or (larger > 0 and smaller > 0)").isEmpty()
