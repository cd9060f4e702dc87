"""Token-id files: one zstandard frame per document under a shared dictionary.

Format. A dataset is a folder of two Parquet tables. ``dictionary`` has one row
(sha256, content). ``blocks`` has a row per block of consecutive documents: ``file_no`` and
``block_no`` (their order), ``dictionary`` (sha256 of the dictionary the frames need),
``id_bytes`` (2 or 4: width of the little-endian ids), the index (``doc_ids``, ``n_tokens``,
``offsets``: frame i is ``frames[offsets[i]:offsets[i + 1]]``) and ``frames``. A short document
is read by decompressing its own frame only; the Parquet statistics of ``first_id`` and
``last_id`` find its block.

The dictionary is trained on serialized id arrays of a bounded sample: at most
``SAMPLE_DOCS`` documents with the smallest id hashes, ``SAMPLE_IDS`` ids of each, ``DICT_BYTES``
of dictionary. It changes sizes only, never what is read back.

Order. The table is range-partitioned by id and sorted inside the partitions before
texts are encoded, so file numbers ascend with the ids; ``start`` is a prefix sum over
blocks and needs no task to see more than its own.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deadwire.llm.common import prefix_sums, text_chunks, tidy
from deadwire.llm.tokens import as_bytes, library_encoder, load_library, public_path

SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 512, 4096, 64 << 10
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _width(path: str) -> int:
    return 2 if load_library(path).get_vocab_size() <= 1 << 16 else 4


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content)


def train_dictionary(docs: DataFrame, id_col: str, text: str, path: str, width: int) -> bytes:
    """The shared dictionary. With too few samples to train on it is their plain content."""
    chosen = docs.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCS).distinct()
    texts = docs.select(id_col, text).join(F.broadcast(chosen), id_col, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch.column(1)):
                ids = as_bytes(*library_encoder(path).encode(batch.column(1).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array([_narrow(x[:4 * SAMPLE_IDS], width) for x in ids], pa.binary())],
                    names=["id", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())])
    rows = texts.mapInArrow(run, schema).orderBy("id", "ids").limit(SAMPLE_DOCS).collect()
    samples = [bytes(r.ids) for r in rows if len(r.ids) >= 8]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:].ljust(8, b"\x01")


_BLOCK = ("file_no int, block_no int, dictionary string, id_bytes int, first_id {0}, last_id {0}, "
          "doc_ids array<{0}>, n_tokens array<bigint>, offsets array<bigint>, frames binary")


def write_tokens(docs: DataFrame, out: str, id_col: str = "doc_id", text: str = "text", path: str | None = None,
                 end_id: int = 1) -> None:
    """Encode every whole text (null: empty) with the tokenizers library, append ``end_id`` and write
    the dataset ``out`` in ascending id order (nulls first, rows of one id by their text's hash)."""
    spark = docs.sparkSession
    path = path or public_path("word_bpe_49k.json")
    docs = docs.select(id_col, text)
    width = _width(path)
    content = train_dictionary(docs, id_col, text, path, width)
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, content)], "sha256 string, content binary").coalesce(1).write.parquet(
        f"{out}/dictionary")
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    end = _narrow(np.uint32(end_id).tobytes(), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep_encoders=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(content))
        encoder, file_no, block_no = library_encoder(path), TaskContext.get().partitionId(), 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).tolist()
            kinds = {"first_id": id_type, "last_id": id_type, "doc_ids": pa.list_(id_type)}
            values = {"file_no": file_no, "block_no": block_no, "dictionary": digest, "id_bytes": width,
                      "first_id": ids[0], "last_id": ids[-1], "doc_ids": ids, "n_tokens": counts,
                      "offsets": offsets, "frames": b"".join(frames)}
            kinds |= {"file_no": pa.int32(), "block_no": pa.int32(), "id_bytes": pa.int32(),
                      "n_tokens": pa.list_(pa.int64()), "offsets": pa.list_(pa.int64()), "frames": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k)) for k, v in values.items()],
                                              names=list(values))

        for batch in batches:
            for a, b in text_chunks(batch.column(1)):
                names = batch.column(0).slice(a, b - a).to_pylist()
                found, sizes = encoder.encode(batch.column(1).slice(a, b - a))
                raw, at = found.astype(f"<u{width}").tobytes(), 0
                for name, size in zip(names, sizes.tolist()):
                    ids.append(name)
                    counts.append(size + 1)
                    frames.append(packer.compress(raw[at:at + width * size] + end))
                    at += width * size
                    held += len(frames[-1])
                    if len(ids) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                        yield block()
                        ids, counts, frames, held, block_no = [], [], [], 0, block_no + 1
        if ids:
            yield block()

    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text)]
    (docs.repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(run, _BLOCK.format(kind))
     .write.option("compression", "uncompressed").parquet(f"{out}/blocks"))


def _content(spark: SparkSession, out: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{out}/dictionary").first()
    if hashlib.sha256(bytes(row.content)).hexdigest() != row.sha256:
        raise ValueError("the dictionary does not have the hash it is stored under")
    return row.sha256, bytes(row.content)


def read_tokens(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """(id, file_no, block_no, inner, n_tokens, ids): every document of the dataset. ``inner``: ids of
    the documents before it in its block; ``ids``: little-endian uint32."""
    digest, content = _content(spark, out)
    blocks = spark.read.parquet(f"{out}/blocks")
    kind = blocks.schema["first_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                if row["dictionary"].as_py() != digest:
                    raise ValueError("a block needs another dictionary")
                frames = memoryview(row["frames"].as_buffer())
                offsets, counts = row["offsets"].as_py(), row["n_tokens"].as_py()
                source = "<u2" if row["id_bytes"].as_py() == 2 else "<u4"
                inner = (np.cumsum(counts) - counts).tolist()
                n, held, begin = len(counts), 0, 0
                ids: list[bytes] = []
                for j in range(n):
                    raw = np.frombuffer(reader.decompress(frames[offsets[j]:offsets[j + 1]]), source)
                    if len(raw) != counts[j]:
                        raise ValueError("a frame does not hold the indexed number of ids")
                    ids.append(raw.astype("<u4").tobytes())
                    held += len(ids[-1])
                    if held >= 4 << 20 or j == n - 1:
                        m = j + 1 - begin
                        yield pa.RecordBatch.from_arrays(
                            [row["doc_ids"].values.slice(begin, m),
                             pa.array([row["file_no"].as_py()] * m, pa.int32()),
                             pa.array([row["block_no"].as_py()] * m, pa.int32()),
                             pa.array(inner[begin:j + 1], pa.int64()), pa.array(counts[begin:j + 1], pa.int64()),
                             pa.array(ids, pa.binary())],
                            names=[id_col, "file_no", "block_no", "inner", "n_tokens", "ids"])
                        ids, held, begin = [], 0, j + 1

    return blocks.select("file_no", "block_no", "dictionary", "id_bytes", "doc_ids", "n_tokens", "offsets",
                         "frames").mapInArrow(
        run, f"`{id_col}` {kind}, file_no int, block_no int, inner bigint, n_tokens bigint, ids binary")


def read_document(spark: SparkSession, out: str, doc_id) -> list[list[int]]:
    """Ids of the documents with one id: only blocks whose id range holds it are read, and only
    its own frames are decompressed."""
    digest, content = _content(spark, out)
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
    from_first = F.col("first_id").isNull() | (F.col("first_id") <= doc_id)  # nulls come first
    rows = (spark.read.parquet(f"{out}/blocks").where(from_first & (F.col("last_id") >= doc_id))
            .select("id_bytes", "dictionary", F.posexplode("doc_ids").alias("i", "id"), "offsets", "frames")
            .where(F.col("id") == doc_id)
            .select("id_bytes", "dictionary",
                    F.expr("substring(frames, int(offsets[i]) + 1, int(offsets[i + 1] - offsets[i]))").alias("frame")))
    out_ids = []
    for r in rows.collect():
        if r.dictionary != digest:
            raise ValueError("a block needs another dictionary")
        out_ids.append(np.frombuffer(reader.decompress(bytes(r.frame)), "<u2" if r.id_bytes == 2 else "<u4").tolist())
    return out_ids


def block_starts(spark: SparkSession, out: str) -> DataFrame:
    """(file_no, block_no, block_start): ids of all documents before each block."""
    sizes = spark.read.parquet(f"{out}/blocks").select(
        "file_no", "block_no", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("held"))
    return prefix_sums(sizes, "file_no", ["block_no"], "held", "block_start").drop("held")
