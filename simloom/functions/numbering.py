"""Numbers of rows in a global order, without one task that orders them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize


def numbered(rows: DataFrame, into: str, *order: str) -> DataFrame:
    """Add ``into``: the place of each row in ascending order, from 0.

    Rows are dealt to ranges, each of which is ordered on its own; only the
    number of rows of each range reaches the driver. Ties are in any order.
    """
    ranges = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted(ranges.groupBy("_range").count().collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets += [F.lit(part), F.lit(before).cast("long")]
        before += n
    place: Column = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    first = F.create_map(*offsets)[F.col("_range")] if offsets else F.lit(0).cast("long")
    return ranges.withColumn(into, place + first).drop("_range")
