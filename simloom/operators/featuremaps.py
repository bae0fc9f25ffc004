"""Operators on spatial feature maps: rows (uid, h, w, c, data), data in row-major order.

The relational form of a map has a row for each cell and channel:
(uid, y, x, ch, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import vectors as V


#: Most queries of an attention map.
QUERIES = 1_000


def cells(maps: DataFrame) -> DataFrame:
    """(uid, y, x, ch, value) of each component."""
    each = maps.select("uid", "w", "c", F.posexplode(V.doubles(F.col("data"))).alias("p", "value"))
    return each.select("uid", F.expr("int(p div (w * c))").alias("y"), F.expr("int(p div c) % w").alias("x"), F.expr("p % c").alias("ch"), "value")


def descriptors(maps: DataFrame) -> DataFrame:
    """(uid, y, x, h, w, desc) of each cell; the cell's channels as an array."""
    place = F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1))
    each = maps.where("h * w > 0").select("uid", "h", "w", "c", "data", place.alias("p"))
    return each.select("uid", F.expr("int(p div w)").alias("y"), F.expr("int(p % w)").alias("x"), "h", "w", V.doubles(F.slice("data", F.col("p") * F.col("c") + 1, F.col("c"))).alias("desc"))


def pooled(maps: DataFrame, how: str, power: float = 3.0) -> DataFrame:
    """(uid, ch, value): max, sum, avg or gmean (generalised mean of the power) of each channel; unit scales the maximum vector to length 1."""
    value = F.col("value")
    kinds = {"max": F.max(value), "sum": F.sum(value), "avg": F.avg(value), "gmean": F.pow(F.avg(F.pow(value, power)), 1.0 / power), "unit": F.max(value)}
    out = cells(maps).groupBy("uid", "ch").agg(kinds[how].alias("value"))
    if how == "unit":
        length = F.sqrt(F.sum(value * value).over(Window.partitionBy("uid")))
        out = out.withColumn("value", F.when(length == 0, 0.0).otherwise(value / length))
    return out


def integral(maps: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(uid, y, x, ch, total): sums of all cells up to and including (y, x), of values raised to ``alpha``."""
    value = F.col("value") if alpha == 1.0 else F.pow("value", F.lit(alpha))
    across = Window.partitionBy("uid", "ch", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("uid", "ch", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return cells(maps).withColumn("part", F.sum(value).over(across)).select("uid", "y", "x", "ch", F.sum("part").over(down).alias("total"))


def rectangle_sums(sums: DataFrame, boxes: DataFrame) -> DataFrame:
    """(uid, box columns, ch, total) of half-open boxes (y1, x1, y2, x2), by the four corners of ``integral``."""

    def corner(y: str, x: str, name: str) -> DataFrame:
        return sums.select("uid", "ch", (F.col("y") + 1).alias(y), (F.col("x") + 1).alias(x), F.col("total").alias(name))

    out = boxes.join(sums.select("uid", "ch").distinct(), "uid")
    for y, x, name in (("y2", "x2", "a"), ("y1", "x2", "b"), ("y2", "x1", "c"), ("y1", "x1", "d")):
        out = out.join(corner(y, x, name), ["uid", "ch", y, x], "left")
    value = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)) - F.coalesce("c", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))
    return out.withColumn("total", value).drop("a", "b", "c", "d")


def encoded(maps: DataFrame) -> DataFrame:
    """(uid, h, w, c, gaps, width, values, low, high): places of the non-zero components as gaps, their values as bytes.

    A map without non-zero components has empty arrays and null bounds.
    """
    places = maps.withColumn("_p", V.sparse_places(F.col("data"))).withColumn("_v", F.transform("_p", lambda i: F.try_element_at(V.doubles(F.col("data")), i + 1)))
    bounds = places.withColumn("low", F.array_min("_v")).withColumn("high", F.array_max("_v"))
    gaps = V.deltas(F.col("_p"))
    return bounds.select("uid", "h", "w", "c", gaps.alias("gaps"), V.delta_width(gaps).alias("width"), V.quantize(F.col("_v"), F.col("low"), F.col("high")).alias("values"), "low", "high")


def decoded(codes: DataFrame) -> DataFrame:
    """(uid, h, w, c, data) of ``encoded``; values are off by at most (high - low) / 510.

    Places are the running sums of the gaps; uids are taken as unique.
    """
    along = Window.partitionBy("uid").orderBy("k")
    filled = codes.select("uid", "low", "high", F.posexplode(F.arrays_zip("gaps", "values")).alias("k", "z"))
    spread = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    known = filled.select("uid", F.sum("z.gaps").over(along).cast("int").alias("p"), (F.col("z.values") / 255.0 * spread + F.col("low")).alias("value"))
    every = codes.select("uid", "h", "w", "c", F.explode(F.sequence(F.lit(0), (F.col("h") * F.col("w") * F.col("c")).cast("int") - 1)).alias("p"))
    whole = every.join(known, ["uid", "p"], "left").groupBy("uid", "h", "w", "c").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("value", F.lit(0.0)).alias("value")))).alias("z"))
    return whole.select("uid", "h", "w", "c", F.col("z.value").alias("data"))


def attention_map(maps: DataFrame, queries: DataFrame) -> DataFrame:
    """(uid, query, y, x, weight): softmax over a map's cells of the scalar products of their channels with each query (query, vector), over the root of the number of channels.

    Queries are few; each cell is multiplied with all of them.
    """
    if queries.limit(QUERIES + 1).count() > QUERIES:
        raise ValueError(f"at most {QUERIES} queries")
    each = descriptors(maps).join(F.broadcast(queries), F.lit(True))
    score = V.dot(F.col("desc"), F.col("vector")) / F.sqrt(F.size("desc").cast("double"))
    weight = softmax(F.col("score"), Window.partitionBy("uid", "query"))
    return each.withColumn("score", score).withColumn("weight", weight).select("uid", "query", "y", "x", "weight")


def gathered(maps: DataFrame, attention: DataFrame, how: str = "sum") -> DataFrame:
    """(uid, query, ch, value): the map's values weighted by its attention and pooled (sum, max, avg), scaled to length 1 for each query."""
    kinds = {"sum": F.sum, "max": F.max, "avg": F.avg}
    weighted = cells(maps).join(attention, ["uid", "y", "x"]).groupBy("uid", "query", "ch").agg(kinds[how](F.col("weight") * F.col("value")).alias("value"))
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("uid", "query")))
    return weighted.withColumn("value", F.when(length == 0, 0.0).otherwise(F.col("value") / length))


def softmax(score: Column, over: Window) -> Column:
    """Softmax of a score within a partition."""
    e = F.exp(score - F.max(score).over(over))
    return e / F.sum(e).over(over)
