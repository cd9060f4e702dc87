"""A global rank by any order (O-1) without sorting in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(rows: DataFrame, by: list[Column], keep, out: str = "rank") -> DataFrame:
    """``rows`` with ``out`` = 1, 2, ... in the order of ``by`` (collated strings included; rows that tie follow one
    another in any order).

    The rows are range-partitioned and sorted inside their partitions; a row's rank is its place in its partition plus
    the sizes of the partitions before, which are one row each. ``keep`` (a function of DataFrame and name) writes the
    sorted rows, so that places and sizes come from one and the same partitioning."""
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    ranged = keep(ranged, "ranked").withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(sizes, "_part").withColumn(out, F.col("_before") + place + 1).drop("_id", "_part", "_before")
