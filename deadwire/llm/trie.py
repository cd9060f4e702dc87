"""Conversation prefix trie: union-find over the LCP edges of sorted neighbours, deepest first.

A conversation is the sequence of its turns' digests (16 bytes each), so shared beginnings are shared
prefixes of byte strings. Sorted, neighbours share the most; an edge joins two neighbours at the depth of their
longest common prefix (LCP). ``forest`` takes the edges in descending depth: every merge of two
components makes a node of that depth, or adds to it, and conversations that end at a depth add to its node.
Stretches without branch or end stay one edge and are written out at the very end.

Spark: a range partitioning sorts the conversations. Each partition is cut into chunks of bounded size, each chunk
is a forest of its own. A node that is no prefix of the chunk's first or last conversation can
gain nothing outside and is final. The others, the chunk's two flanks, are contracted: what hangs off them
becomes weights, and a chunk is one row of two keys and some (depth, weights) items. Neighbouring chunks, ``FAN`` at a
time, go through the same union-find, with the LCP at their boundaries as edges, until one is left.

A conversation is one row of 24 bytes a turn; its texts are dropped where they are read. Equal conversations in
any number are spread by their ids. Only the list of their ids, which one sequential hash must read, is streamed
through one task, in strings of ``IDS`` ids.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deadwire.llm.common import materialize

#: Conversations and key bytes of a chunk, chunks merged at once, ids in one piece of a long list.
CHUNK_ROWS, CHUNK_BYTES, FAN, IDS = 1 << 15, 16 << 20, 64, 2048
DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODES = ("chunk string, id binary, depth int, parent_id binary, parent_conv long, low long, n long, kids long, "
          "leaves long, ends string, saved array<long>")
_OUT = (_NODES + ", end_id binary, piece int, ids string, pid long, seq long, first binary, first_sizes array<long>, "
        "last binary, last_sizes array<long>, items array<struct<side: int, depth: int, n: long, kids: long, leaves: long, "
        "below: long, low: long>>")


def turn_digest(role: Column, text: Column) -> Column:
    """Hex digest of a turn: 128 bits of a sha256 over both fields with the first one's length; null: empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


# -- the forest of one chunk -------------------------------------------------------------------

@dataclass
class Node:
    """``low``: smallest id of its conversations; ``below``: saved bytes of all nodes beneath it."""
    depth: int
    first: int
    last: int
    n: int = 0
    kids: int = 0
    leaves: int = 0
    below: int = 0
    low: int | None = None
    children: list[Node] = field(default_factory=list)

    def add(self, n: int, kids: int, leaves: int, below: int, low: int | None) -> None:
        self.n, self.kids, self.leaves, self.below = self.n + n, self.kids + kids, self.leaves + leaves, self.below + below
        if low is not None and (self.low is None or low < self.low):
            self.low = low


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // DIGEST


def forest(edges: list[int], items: list[tuple[int, int, tuple]], totals: list[np.ndarray], whole: bool) -> list[Node]:
    """Nodes, deepest first, over sorted keys 0, 1, ...

    ``edges[i]``: LCP of keys i and i + 1. ``items``: (key, depth, weights) of what is known to be at a prefix of
    a key. ``totals[key][d]``: bytes of its first d turns. A node's children are in ``children``. Final nodes have all
    their weights; a flank node (no final one unless ``whole``) has its items' and its final children's only."""
    root = list(range(len(edges) + 1))
    span = [(i, i) for i in root]
    top: list[Node | None] = [None] * len(root)
    nodes: list[Node] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def at(comp: int, depth: int) -> Node:
        """The component's node of this depth; a new one takes its present top as child."""
        above = top[comp]
        if above is None or above.depth != depth:
            node = Node(depth, *span[comp])
            if above is not None:
                node.children.append(above)
            nodes.append(node)
            top[comp] = node
        return top[comp]

    order = sorted([(-d, 0, i, None) for i, d in enumerate(edges)] + [(-d, 1, i, w) for i, d, w in items],
                   key=lambda e: e[:3])
    for depth, is_item, i, weights in order:
        if is_item:
            at(find(i), -depth).add(*weights)
            continue
        left, right = find(i), find(i + 1)
        node, other = at(left, -depth), top[right]
        if other is not None:
            node.children.append(other)
        root[right] = left
        span[left] = (span[left][0], span[right][1])
        node.first, node.last = span[left]
    last = len(edges)
    for node in nodes:
        for c in node.children:
            if whole or not (c.first == 0 or c.last == last):
                bytes_in = totals[c.first]
                node.add(c.n, 1, c.leaves, c.below + (c.n - 1) * int(bytes_in[c.depth] - bytes_in[node.depth]), c.low)
        if not node.kids and (whole or not (node.first == 0 or node.last == last)):
            node.leaves = 1
    return nodes


class _Ids:
    """Digests of growing prefixes of a key, asked for by depth."""

    def __init__(self, key: bytes):
        self.key, self.known = key, {}

    def at(self, depth: int) -> bytes:
        if depth not in self.known:
            self.known[depth] = hashlib.sha256(memoryview(self.key)[:depth * DIGEST]).digest()[:DIGEST]
        return self.known[depth]


class _Writer:
    """Collects the rows of chunks: final nodes, pieces of long id lists, and the contracted chunk."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def chunk(self, name: str, pid: int, seq: int, keys: list[bytes], sizes: list, items: list, whole: bool,
              convs: list[list[int]] | None = None) -> None:
        """``convs``: ids of the conversations that are key 0, 1, ..., where the chunk holds conversations."""
        totals = [np.concatenate([[0], np.cumsum(np.asarray(s, np.int64))]) for s in sizes]
        last = len(keys) - 1
        paths = {0: _Ids(keys[0]), last: _Ids(keys[-1])}
        nodes = forest([lcp(a, b) for a, b in zip(keys, keys[1:])], items, totals, whole)
        parents = {id(c): node for node in nodes for c in node.children}
        flanks = []
        for node in nodes:
            on_flank = node.first == 0 or node.last == last
            ids = convs[node.first] if convs and len(keys[node.first]) == node.depth * DIGEST else []
            if on_flank and not whole:
                side = int(node.first != 0)
                flanks.append((side, node.depth, node.n, node.kids, node.leaves, node.below, node.low))
                for k in range(0, len(ids), IDS):  # the list may go on in the next chunk
                    self.rows.append({"end_id": paths[side * last].at(node.depth), "pid": pid, "seq": seq,
                                      "piece": k // IDS, "ids": ",".join(map(str, ids[k:k + IDS]))})
                continue
            row = {"chunk": name, "depth": node.depth, "low": node.low, "n": node.n, "kids": node.kids, "leaves": node.leaves}
            if convs is not None:
                row["ends"] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            else:  # its conversations' ids come from other chunks too
                side = last if node.first and node.last == last else node.first
                row["id"] = (paths.get(side) or _Ids(keys[side])).at(node.depth)
            above = parents.get(id(node))
            begin = 0 if above is None else above.depth + 1
            if above is not None:
                if whole or not (above.first == 0 or above.last == last):
                    row["parent_conv"] = above.low
                else:
                    row["parent_id"] = paths[0 if above.first == 0 else last].at(above.depth)
            # node.depth - begin + 1 nodes lie on the edge; the root has no text
            through = totals[node.first][begin - 1 if begin else 0:node.depth + 1]
            own = through[-1] - through[:-1] if begin else np.zeros(1, np.int64)
            row["saved"] = node.below + (node.n - 1) * own
            self.rows.append(row)
        if not whole:
            self.rows.append({"pid": pid, "seq": seq, "first": keys[0], "first_sizes": sizes[0], "last": keys[-1],
                              "last_sizes": sizes[-1], "items": flanks})

    def table(self, schema: pa.Schema) -> pa.Table:
        columns = [pa.array([r.get(f.name) for r in self.rows], f.type) for f in schema]
        self.rows = []
        return pa.Table.from_arrays(columns, schema=schema)


_ITEM = pa.struct([("side", pa.int32()), ("depth", pa.int32()), ("n", pa.int64()), ("kids", pa.int64()),
                   ("leaves", pa.int64()), ("below", pa.int64()), ("low", pa.int64())])
_ARROW = pa.schema([
    ("chunk", pa.string()), ("id", pa.binary()), ("depth", pa.int32()), ("parent_id", pa.binary()),
    ("parent_conv", pa.int64()), ("low", pa.int64()), ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()),
    ("ends", pa.string()), ("saved", pa.list_(pa.int64())), ("end_id", pa.binary()), ("piece", pa.int32()),
    ("ids", pa.string()), ("pid", pa.int64()), ("seq", pa.int64()), ("first", pa.binary()),
    ("first_sizes", pa.list_(pa.int64())), ("last", pa.binary()), ("last_sizes", pa.list_(pa.int64())),
    ("items", pa.list_(_ITEM))])


_SUMMARY = _ARROW.names[_ARROW.names.index("pid"):]


def _batches(writer: _Writer) -> Iterator[pa.RecordBatch]:
    if writer.rows:
        yield from writer.table(_ARROW).combine_chunks().to_batches()


def _scan(rows: int, held: int):
    """Sorted (key, conv_id, sizes) rows of a partition -> chunk by chunk its forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq = TaskContext.get().partitionId(), 0
        keys: list[bytes] = []
        convs: list[list[int]] = []
        sizes: list = []
        count = size = 0
        writer = _Writer()

        def close() -> None:
            items = [(i, len(key) // DIGEST, (len(ids), 0, 0, 0, ids[0])) for i, (key, ids) in enumerate(zip(keys, convs))]
            writer.chunk(f"{pid}.{seq}", pid, seq, keys, sizes, items, False, convs)

        for batch in batches:
            for key, conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if count >= rows or size >= held:
                    close()
                    yield from _batches(writer)
                    keys, convs, sizes, count, size = [], [], [], 0, 0
                    seq += 1
                if not keys or keys[-1] != key:
                    keys.append(key)
                    convs.append([])
                    sizes.append(parts.values.to_numpy(zero_copy_only=False))
                    size += 24 * len(sizes[-1])
                convs[-1].append(conv)
                count += 1
        if keys:
            close()
            yield from _batches(writer)

    return run


def _merge(whole: bool):
    """Neighbouring contracted chunks -> their forest, contracted again (or final if ``whole``)."""
    def run(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys: list[bytes] = []
        sizes: list[list[int]] = []
        items: list[tuple] = [(0, 0, (0, 0, 0, 0, None))] if whole else []
        rows = rows.sort_by([("pid", "ascending"), ("seq", "ascending")]).to_pylist()
        for r in rows:
            items += [(len(keys) + x["side"], x["depth"], (x["n"], x["kids"], x["leaves"], x["below"], x["low"]))
                      for x in r["items"]]
            keys += [r["first"], r["last"]]
            sizes += [r["first_sizes"], r["last_sizes"]]
        pid, seq = (g.as_py() for g in group)
        writer = _Writer()
        writer.chunk(f"{rows[0]['round']}.{pid}.{seq}", pid, seq, keys, sizes, items, whole)
        return writer.table(_ARROW)

    return run


def trie(conversations: DataFrame, id_col: str = "conv_id", turns: str = "turns", chunk_rows: int = CHUNK_ROWS,
         chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per distinct
    prefix of the conversations' turns, the empty one included.

    ``turns``: array<struct<digest: string, size: bigint>>, in order (see ``turn_digest``); null or empty: the
    conversation ends at the root. Rows with a null id are left out, since members are listed by id; rows that repeat
    an id are members of their own. ``saved_tokens``: summed over the subtree, (members - 1) times the
    size of the last turn. ``n_leaves`` counts a childless node itself. Other columns are ignored; a table without
    conversations gives no rows, not even the root."""
    turn = F.coalesce(F.col(turns), F.array().cast("array<struct<digest: string, size: bigint>>"))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.unhex(F.array_join(F.transform(turn, lambda t: t["digest"]), "")).alias("key"),
        F.col(id_col).cast("long").alias("conv"), F.transform(turn, lambda t: t["size"].cast("long")).alias("sizes"))
    rows = materialize(rows, "keys")
    ordered = rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    found = materialize(ordered.mapInArrow(_scan(chunk_rows, chunk_bytes), _OUT), "forests")
    made = [found]
    summaries = found.where("first is not null")
    most = summaries.agg(F.max("pid"), F.max("seq")).first()
    pid, seq = most[0] or 0, most[1] or 0
    whole = False
    while not whole:
        if seq > 0:  # neighbours inside a partition first
            seq //= fan
            place = F.col("pid"), F.floor(F.col("seq") / fan)
        else:  # then neighbouring partitions
            pid //= fan
            place = F.floor(F.col("pid") / fan), F.lit(0).cast("long")
        whole = pid == 0 and seq == 0
        grouped = summaries.select(*_SUMMARY, F.lit(len(made)).alias("round"), place[0].alias("to_pid"), place[1].alias("to_seq"))
        merged = materialize(grouped.groupBy("to_pid", "to_seq").applyInArrow(_merge(whole), _OUT), "forests")
        made.append(merged)
        summaries = merged.where("first is not null")
    return _rows(made, found).select(F.col("conv_id").alias(id_col), *(c for c in _RESULT if c != "conv_id"))


_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _joined_digest(pieces: DataFrame) -> DataFrame:
    """(end_id, ends): sha256 of all pieces of an id list, in order, joined by commas; streamed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for end_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if end_id != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = end_id, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield _pairs(done)
        if now is not None:
            yield _pairs([(now, state.hexdigest())])

    return (pieces.repartition("end_id").sortWithinPartitions("end_id", "pid", "seq", "piece").select("end_id", "ids")
            .mapInArrow(run, "end_id binary, ends string"))


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()),
                                       pa.array([r[1] for r in rows], pa.string())], names=["end_id", "ends"])


def _rows(made: list[DataFrame], found: DataFrame) -> DataFrame:
    """The nodes of all rounds, a row per depth of their edges."""
    nodes = made[0]
    for more in made[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.where("n is not null").select(*_ARROW.names[:_ARROW.names.index("end_id")])
    listed = _joined_digest(found.where("end_id is not null").select("end_id", "pid", "seq", "piece", "ids"))
    late = materialize(nodes.where("id is not null").drop("ends").join(listed, F.col("id") == F.col("end_id"), "left")
                       .drop("end_id"), "flank-nodes")
    nodes = nodes.where("id is null").unionByName(late)
    # a final node under a flank: the flank's smallest id is looked up per chunk, so that a hot parent is many keys
    wanted = nodes.where("parent_id is not null").select("chunk", "parent_id").distinct()
    names = wanted.join(late.select(F.col("id").alias("parent_id"), F.col("low").alias("named")), "parent_id")
    nodes = nodes.join(names, ["chunk", "parent_id"], "left")
    bottom = F.col("at") == F.size("saved") - 1
    return (nodes.select("*", F.posexplode("saved").alias("at", "saved_tokens"))
            .select(F.col("low").alias("conv_id"),
                    (F.col("depth") - F.size("saved") + 1 + F.col("at")).cast("long").alias("depth"),
                    F.when(F.col("at") > 0, F.col("low")).otherwise(F.coalesce("named", "parent_conv")).alias("parent_conv_id"),
                    F.col("n").alias("n_convs"), F.when(bottom, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
                    F.col("leaves").alias("n_leaves"), "saved_tokens",
                    F.when(bottom, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256")))
