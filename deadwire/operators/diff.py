"""The diff: public API over DataFrames.

``compute_diff(defined, accessed)`` keeps the defined rows whose ``name`` no
accessed row of the same field set has: case-sensitive, by name only (side is
ignored), every duplicate and column of ``defined`` kept. ``run_diff`` adds
the daily waste score from the field set's endpoint pattern. Neither changes
its inputs (DataFrames are immutable).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deadwire.functions.scalars import score_waste


def compute_diff(defined: DataFrame, accessed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Left anti-join on ``keys + [name]`` against the distinct accessed names.
    Not EXCEPT: that would also de-duplicate ``defined``."""
    names = accessed.select(*keys, "name").distinct()
    return defined.join(names, [*keys, "name"], "left_anti")


def run_diff(defined: DataFrame, accessed: DataFrame, keys: Sequence[str] = (),
             pattern_col: str | None = "pattern") -> DataFrame:
    """Dead fields with ``waste_score`` = estimated bytes x daily requests of
    the endpoint pattern (default tier when there is no pattern)."""
    dead = compute_diff(defined, accessed, keys)
    pat = F.col(pattern_col) if pattern_col and pattern_col in dead.columns else None
    return dead.withColumn("waste_score", score_waste(F.col("name"), pat))
