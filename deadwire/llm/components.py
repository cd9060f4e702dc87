"""Connected components by alternating star contraction.

Each round hangs every node's larger neighbours (large star) and then its smaller
ones (small star) under the smallest node it knows; the edge list becomes a set of
stars after a logarithmic number of rounds. The smallest neighbour comes from a
pre-aggregated ``min`` and goes back by a join that adaptive execution can split (``join_back``),
so the centre of a huge star is not one task's work. Every round is a written
table; the driver only sees a count and a checksum of it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deadwire.llm.common import join_back, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:  # a is the larger end
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = join_back(both, least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root): the smallest node of its component, for
    every node that has an edge to another. Null ends and loops are left out;
    repeated edges count once; no edges give no rows."""
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    now, seen = materialize(edges, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not mark[0] or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        now = materialize(_star(_star(now, True), False), "edges")
