"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of the largest length and then of the binary
digits of the rest (1,300 = 1024 + 256 + 16 + 4). Each piece is a sequence of its own, so
no sequence crosses documents and none is padded; sequences of one length form a
bucket that a trainer can batch whole.

Spark: one Arrow stage over the texts writes the pieces with their place in (length,
task); the counts per (length, task) become offsets by a prefix sum over at most
lengths x tasks rows, and sequence numbers run through one bucket after the other.
Nothing but those counts is shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deadwire.llm.common import materialize, text_chunks, tidy
from deadwire.llm.tokens import library_encoder, public_path

MAX_TOKENS = 1024


def lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Piece lengths of a document of ``n`` tokens; ``most`` is a power of two."""
    out = [most] * (n // most)
    rest = n % most
    return out + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 0,
           most: int = MAX_TOKENS) -> DataFrame:
    """(id, start, length, doc_tokens, task, slot, ids): the pieces of every whole text (null:
    empty) with ``end_id`` appended; ``ids`` little-endian uint32, ``slot`` counts the
    pieces of one length in one task. Repeated rows and null ids are documents like others."""
    if most < 1 or most & (most - 1):
        raise ValueError("the largest length is a power of two")
    path = path or public_path("byte_bpe_50k.json")
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep_encoders=True)
        task, slots = TaskContext.get().partitionId(), {}
        for batch in batches:
            for a, b in text_chunks(batch.column(1)):
                found, counts = library_encoder(path).encode(batch.column(1).slice(a, b - a))
                raw, begin = found.astype("<u4", copy=False).tobytes(), 0
                rows: list[tuple] = []
                owner: list[int] = []
                for i, count in enumerate(counts.tolist()):
                    n, at = count + 1, 0
                    for size in lengths(n, most):
                        slot = slots.get(size, 0)
                        slots[size] = slot + 1
                        ids = raw[begin + 4 * at:begin + 4 * min(at + size, count)]
                        rows.append((at, size, n, slot, ids if at + size <= count else ids + end))
                        owner.append(a + i)
                        at += size
                    begin += 4 * count
                start, size, n, slot, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(n, pa.int64()), pa.array([task] * len(rows), pa.int32()), pa.array(slot, pa.int64()),
                     pa.array(ids, pa.binary())],
                    names=[id_col, "start", "length", "doc_tokens", "task", "slot", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(
        run, f"`{id_col}` {kind}, start bigint, length bigint, doc_tokens bigint, task int, slot bigint, ids binary")


def number_sequences(written: DataFrame) -> DataFrame:
    """(length, task, base) of written pieces: a piece's sequence number is base + slot."""
    sizes = written.groupBy("length", "task").agg(F.count("*").alias("n"))
    per_length = sizes.groupBy("length").agg(F.sum("n").alias("n"))
    before = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    bucket = per_length.select(F.col("length").alias("_length"),
                               F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket"))
    inside = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(bucket, F.col("length") == F.col("_length"))
            .select("length", "task", (F.col("bucket") + F.col("inside")).alias("base")))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 0,
         most: int = MAX_TOKENS, keep_ids: bool = True) -> DataFrame:
    """(id, start, length, doc_tokens, sequence_id, offset, ids or ids_crc32): every piece with the
    sequence that it is. With ``keep_ids`` false the ids' CRC-32 stands for them, so that the
    numbering join moves none."""
    written = materialize(pieces(docs, id_col, text, path, end_id, most), "pieces")
    body = F.col("ids") if keep_ids else F.crc32("ids").alias("ids_crc32")
    rows = written.select(id_col, "start", "length", "doc_tokens", "task", "slot", body)
    base = number_sequences(written)
    return (rows.join(base, ["length", "task"])
            .withColumn("sequence_id", F.col("base") + F.col("slot")).withColumn("offset", F.lit(0).cast("long"))
            .select(id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids" if keep_ids else "ids_crc32"))
