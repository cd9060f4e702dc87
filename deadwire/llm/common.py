"""Shared helpers of the training-data operators: table access, written
intermediate tables in the shared folder, and bounded Arrow batches."""
from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deadwire.session import ensure_checkpoint_dir

#: Text bytes that one numpy pass works on; a longer single document is one pass of its own.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, through Spark's reader (``sf_dir`` may be any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/deadwire-llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so a
    lost executor costs a reread and never a recomputation."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_back(rows: DataFrame, grouped: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` to an aggregate ``grouped`` by the long ``key``, so that adaptive execution
    can split a hot key. An aggregate already lies by its key and would be joined in the tasks that
    made it, where nothing splits; the complement of the key names the same groups, but has to be
    shuffled for both sides. A null key joins nothing."""
    return (rows.withColumn("_back", F.bitwise_not(key))
            .join(grouped.withColumn("_back", F.bitwise_not(key)).drop(key), "_back").drop("_back"))


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``limit`` bytes each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def tidy(keep_encoders: bool = False) -> None:
    """Give a reused Python worker's memory back: the encoders' caches (which only stages that encode
    need) and what the allocators hold free."""
    tokens = sys.modules.get("deadwire.llm.tokens")
    if tokens is not None and not keep_encoders:
        tokens._ENCODERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def prefix_sums(df: DataFrame, partition: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over (partition, *order), where ``df`` is
    already numbered by a written ``partition`` column. Sums per partition are
    added up first, so no task sees more than its own rows and one row per
    partition."""
    from pyspark.sql import Window
    sums = df.groupBy(partition).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy(partition).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(partition).alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(base, F.col(partition) == F.col("_p"))
            .withColumn(out, F.col("_base") + F.col("_in"))
            .drop("_p", "_base", "_in"))
