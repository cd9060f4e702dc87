"""Points in ranges (J7) as a Spark join.

A range of length n lies in at most two neighbouring blocks of any size of n or more. Ranges are sorted into levels of
block sizes 1, 16, 256, ...; a range is one or two rows of its level's blocks, a point one row per level that occurs.
Both meet by an equality join on keys, level and block, with the exact bounds as condition, so nested, overlapping and
very long ranges cost two rows each, a hot key is spread over its blocks, and adaptive execution can split the rest.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = 16


def contained(points: DataFrame, ranges: DataFrame, keys: list[str], at: str = "at", start: str = "start",
              end: str = "end") -> DataFrame:
    """The rows of ``points`` whose ``at`` lies in [start, end) of some row of ``ranges`` with the same keys, each as often
    as it stands in ``points``. Null keys, points and bounds match nothing; empty ranges hold nothing."""
    size = F.col("_end") - F.col("_start")
    held = ranges.select(*keys, F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end")) \
        .where("_end > _start").distinct()
    longest = held.agg(F.max(size)).first()[0] or 0
    levels = 1
    while BASE ** (levels - 1) < longest:
        levels += 1
    level = sum(((size > BASE ** j).cast("int") for j in range(levels - 1)), F.lit(0))
    width = F.element_at(F.array(*(F.lit(BASE ** j) for j in range(levels))), F.col("_level") + 1)
    held = held.withColumn("_level", level).withColumn("_block", F.explode(F.array_distinct(F.array(
        F.floor(F.col("_start") / width), F.floor((F.col("_end") - 1) / width)))))
    # equal points are looked up once; the level of a block is part of the key
    asked = points.select(*keys, F.col(at).cast("long").alias("_at")).distinct()
    asked = asked.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn(
        "_block", F.floor(F.col("_at") / width))
    hits = asked.join(held, [*keys, "_level", "_block"]).where("_at >= _start and _at < _end").select(*keys, "_at").distinct()
    return points.withColumn("_at", F.col(at).cast("long")).join(hits, [*keys, "_at"], "left_semi").select(*points.columns)
