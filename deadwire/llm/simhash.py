"""SimHash near-duplicates by bit-sliced comparison.

1. Fingerprints: one Arrow pass per text (XXH64 of every shingle, majority per bit).
2. Distinct fingerprints are dealt to cells. With a radius of r bits, the 64 bits are cut
   into b > r blocks: two fingerprints within the radius agree on b - r blocks at least, so
   each fingerprint goes to one cell per choice of b - r blocks and their value. Every b is
   exact; ``cut_for`` takes the one whose cells cost the fewest copies for the number of
   distinct fingerprints, so cells do not fill as the table grows. A cell with more than
   ``CELL`` members all the same (texts that resemble one another) is split into sub-blocks
   by a hash of the fingerprint and compared pair of sub-blocks by pair of sub-blocks, so no
   task holds more than 2 * CELL of them and none is left out.
3. Inside a cell the fingerprints are stored vertically, one bit plane per bit position;
   a carry-save adder tree sums eight planes at a time into bitwise counters, for 64
   distances in each machine word, and a block of queries is abandoned as soon as all its
   distances are beyond the radius.
4. A cell answers with at most one edge per member (to the root of its local group), and
   ``components`` joins the cells' groups. Links inside a large group are never written out.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deadwire.llm.common import join_back, materialize, text_chunks, tidy
from deadwire.llm.components import components
from deadwire.llm.words import normalized, split_words

#: Members of one (sub-)cell.
CELL = 2048
_A, _Z = 0x41, 0x5A


def _fold(column: pa.Array) -> pa.Array:
    """A-Z to lower case, other characters as they are."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = column.buffers()
    if parts[2] is None:
        return column
    data = np.frombuffer(parts[2], np.uint8)
    data = np.where((data >= _A) & (data <= _Z), data | 0x20, data)
    return pa.Array.from_buffers(column.type, len(column), [parts[0], parts[1], pa.py_buffer(data)],
                                 offset=column.offset)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes: the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    first = (np.cumsum(counts) - counts)[some]
    for byte in range(8):
        octet = ((hashes >> np.uint64(8 * byte)) & np.uint64(0xFF)).astype(np.uint8)
        bits = np.unpackbits(octet[:, None], axis=1, bitorder="little")
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        won = np.packbits(2 * sums > counts[some, None], axis=1, bitorder="little")[:, 0]
        out[some] |= won.astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    """SimHash of each text of a string column (uint64)."""
    words = split_words(_fold(column))
    data, starts, ends = normalized(words)
    counts, first = words.counts, words.first[:-1]
    each = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), each)
    at = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each))
    last = at + np.minimum(counts[doc], shingle) - 1
    view, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], 42) for a, b in zip(starts[at].tolist(), ends[last].tolist())),
                         np.uint64, len(at))
    return _majority(hashes, each)


def simhash(docs: DataFrame, shingle: int = 4, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``fp`` (the fingerprint as a signed long). No words: 0."""
    rest = [c for c in docs.columns if c not in (text, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            column = batch.column(len(rest))
            for a, b in text_chunks(column):
                found = fingerprints(column.slice(a, b - a), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(rest))] + [pa.array(found)],
                    names=[*rest, "fp"])

    return docs.select(*rest, text).mapInArrow(run, docs.select(*rest).schema.add("fp", "long"))


# -- bit-sliced comparison ---------------------------------------------------------------

def _planes(fps: np.ndarray) -> np.ndarray:
    """[64, words]: bit i of fingerprint j is bit j % 64 of word j // 64 in plane i."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[:len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1,
                                    bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _add(a, b, c):
    """Carry-save adder: (sum, carry) of three bit vectors."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """[queries, words] bit masks of the plane members within ``radius`` bits.

    Per group of eight planes seven adders reduce the differences to weights 1, 2, 4, 8;
    weight 8 and above goes to a small ripple counter. A group's running count can only
    grow, so once every lane is beyond the radius the block is abandoned."""
    flip = np.where(np.unpackbits(np.ascontiguousarray(queries).view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").astype(bool), ~np.uint64(0), np.uint64(0))
    shape = (len(queries), planes.shape[1])
    ones, twos, fours = (np.zeros(shape, np.uint64) for _ in range(3))
    high = np.zeros((4, *shape), np.uint64)
    for group in range(0, 64, 8):
        d = [planes[group + i][None, :] ^ flip[:, group + i, None] for i in range(8)]
        ones, a = _add(ones, d[0], d[1])
        ones, b = _add(ones, d[2], d[3])
        twos, c = _add(twos, a, b)
        ones, a = _add(ones, d[4], d[5])
        ones, b = _add(ones, d[6], d[7])
        twos, e = _add(twos, a, b)
        fours, carry = _add(fours, c, e)
        for k in range(4):
            high[k], carry = high[k] ^ carry, high[k] & carry
        near = _at_most([ones, twos, fours, *high], radius)
        if not near.any():
            break
    return near


def _at_most(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose bitwise counter (lowest weight first) is ``limit`` or less."""
    less, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for k in reversed(range(len(counter))):
        if limit >> k & 1:
            less |= equal & ~counter[k]
            equal &= counter[k]
        else:
            equal &= ~counter[k]
    return less | equal


def groups(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Local group of each of ``left`` (and then ``right``): the index of the first member.
    With ``right``, only pairs between the two sides are compared; without, all of ``left``."""
    n = len(left)
    against = left if right is None else right
    shift = 0 if right is None else n
    planes = _planes(against)
    root = np.arange(n + (0 if right is None else len(right)))
    valid = np.packbits(np.arange(planes.shape[1] * 64) < len(against), bitorder="little").view(np.uint64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, (1 << 17) // max(1, planes.shape[1]))
    for at in range(0, n, step):
        near = within(left[at:at + step], planes, radius) & valid
        if right is None:  # each pair once
            mine = np.arange(at, at + len(near))
            near[np.arange(len(near)), mine // 64] &= ~(np.uint64(1) << (mine % 64).astype(np.uint64))
        rows = np.flatnonzero(near.any(axis=1))
        for r in rows.tolist():
            hits = np.flatnonzero(np.unpackbits(near[r].view(np.uint8), bitorder="little")) + shift
            mine = find(at + r)
            for other in np.unique(root[hits]).tolist():
                other = find(other)
                if other != mine:
                    mine, other = min(mine, other), max(mine, other)
                    root[other] = mine
            root[hits] = mine
            root[at + r] = mine
    for i in range(len(root)):
        root[i] = find(i)
    return root


def copies(n: int, blocks: int, radius: int) -> float:
    """Rows that one of ``n`` evenly spread fingerprints becomes when the 64 bits are cut into ``blocks``:
    the choices of blocks, times the sub-cells of a cell. The narrowest choice counts."""
    bits = 64 // blocks * (blocks - radius)
    return comb(blocks, radius) * max(1.0, n / 2 ** bits / CELL)


def cut_for(n: int, radius: int) -> int:
    """Number of blocks with the fewest ``copies`` of each of ``n`` fingerprints, the smallest of equals."""
    return min(range(radius + 1, min(64, 2 * radius + 2) + 1), key=lambda b: (copies(n, b, radius), b))


def _cells(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """fps(fp) -> (block, value, i, j, side, fp): ``block`` numbers the choice of blocks, ``value`` holds
    their bits; sub-cell pairs i <= j; side 0 belongs to sub-block i, side 1 to sub-block j."""
    cut = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [(1 << cut[k + 1]) - (1 << cut[k]) for k in range(blocks)]
    chosen = [sum(c) for c in combinations(masks, blocks - radius)]
    value = [F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in chosen]
    dealt = fps.select("fp", F.posexplode(F.array(*value)).alias("block", "value"))
    sizes = (dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
             .select("block", "value", F.ceil(F.col("n") / CELL).cast("int").alias("parts")))
    dealt = dealt.join(sizes, ["block", "value"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("other", other)
    return dealt.select("block", "value", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                        (F.col("part") > F.col("other")).cast("int").alias("side"), "fp")


def _compare(radius: int):
    def cell(rows: np.ndarray, sides: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        if same:
            members, root = rows, groups(rows, None, radius)
        else:
            a, b = rows[sides == 0], rows[sides == 1]
            members = np.concatenate([a, b])
            root = groups(a, b, radius) if len(a) and len(b) else np.arange(len(members))
        hung = np.flatnonzero(root != np.arange(len(root)))
        return members[hung], members[root[hung]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: list[list[np.ndarray]] = []

        def flush(parts: list[list[np.ndarray]]):
            keys, sides, fps = (np.concatenate([p[k] for p in parts]) for k in range(3))
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            bounds = [0, *edges.tolist(), len(keys)]
            found = [cell(fps[a:b], sides[a:b], keys[a, 2] == keys[a, 3])
                     for a, b in zip(bounds[:-1], bounds[1:]) if b - a > 1]
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(4)], axis=1)
            part = [keys, np.asarray(batch.column(4)), np.asarray(batch.column(5)).view(np.uint64)]
            change = np.flatnonzero(np.any(keys != keys[-1], axis=1))
            if not len(change):
                if held and np.any(held[-1][0][-1] != keys[0]):
                    yield from flush(held)
                    held = []
                held.append(part)
                continue
            last = int(change[-1]) + 1  # the last cell may go on in the next batch
            yield from flush([*held, [x[:last] for x in part]])
            held = [[x[last:] for x in part]]
        if held:
            yield from flush(held)

    return run


def links(fps: DataFrame, radius: int) -> DataFrame:
    """fps(fp long, distinct) -> edges (a, b) whose components are those of all pairs
    within ``radius`` bits. Counts ``fps`` first, to choose the cut."""
    key = ["block", "value", "i", "j"]
    cells = _cells(fps, radius, cut_for(fps.count(), radius)).repartition(*key).sortWithinPartitions(*key, "side", "fp")
    return cells.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4,
                    radius: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp long, *carry, root, component_id): every text's fingerprint, the smallest fingerprint and the
    smallest id that it reaches through links of ``radius`` differing bits or fewer.

    Null and empty texts have fingerprint 0 and link like any other. A null id has a
    row too, but names no component (component_id is null only if all ids that it
    reaches are null). Repeated rows each come back; an empty table gives no rows."""
    rows = materialize(simhash(docs.select(id_col, text, *carry), shingle, text), "simhash")
    fps = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-fps")
    found = components(links(fps.select("fp"), radius))
    roots = fps.join(found, fps.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    fp_names = join_back(roots, named, "root").select("fp", "root", "component_id")
    return rows.join(fp_names, "fp").select(id_col, "fp", *carry, "root", "component_id")


def fingerprint_hex(fp: str = "fp"):
    """The fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
