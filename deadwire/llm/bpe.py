"""Byte-pair encoding by segment trees over adjacent pair ranks, and decoding.

Each piece of text is a row of symbols; leaf i of its segment tree holds the key
``rank * 2^32 + i`` of the pair (symbol i, next symbol), or infinity where there is no
merge. The root is then the leftmost pair of the lowest rank. A merge changes
the pair at i, the pair before it and the dead pair after it: three leaves, so three
paths of logarithmic length. It goes on until the root is infinite.

Pieces of similar length share one array of trees and are stepped together, so numpy does the work of
thousands of pieces per call; a finished piece leaves the step. In pieces of more than ``BATCHED`` bytes a step
takes all places of the root's rank that do not overlap, from the left: they are found from the root down, through
the nodes of that rank. This gives the merges one by one would give, as long as no pair that holds the merged symbol
ranks lower than the merge; where one does, the step takes the root's place alone. A piece of n bytes takes O(n log n)
point updates whatever its length, in no more steps than the table has ranks.

The Spark side is a scan and one Arrow stage: each text is encoded whole, decoded from
its ids, and nothing is shuffled.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from deadwire.llm.common import text_chunks
from deadwire.llm.tokens import as_bytes, public_path, tree_encoder

_NONE = np.int64(2 ** 62)
#: Longest pieces (a power of two) that merge one place a step; results are the same on both sides of it.
BATCHED = 32

#: The pre-tokenizer's split (a fixed value) with the library's white space: Python's \\s would add
#: U+001C to U+001F; and the same for texts of ASCII characters only.
_SPACES = "\\t-\\r " + "".join(f"\\u{c:04X}" for c in (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_FIND = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+" + f"| ?[^{_SPACES}\\p{{L}}\\p{{N}}]+"
                      f"|[{_SPACES}]+(?=\\Z|[{_SPACES}])|[{_SPACES}]+").findall
_FIND_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
                         r"|[\t-\r ]+(?=\Z|[\t-\r ])|[\t-\r ]+").findall


def _byte_chars() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    rest = [b for b in range(256) if b not in set(shown)]
    out.update({chr(256 + k): b for k, b in enumerate(rest)})
    return out


@dataclass
class Vocabulary:
    """``byte_ids``: id of each single byte; ``pairs`` (sorted left << 32 | right), ``ranks``
    and ``merged``: the merge table; ``safe``: by rank, whether all pairs with the merged symbol rank higher; ``strings``: bytes of each id; ``added``: ids of special tokens;
    ``split``: cuts a text around them."""
    byte_ids: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    safe: np.ndarray
    strings: list[bytes]
    added: dict[str, bytes]
    split: Callable[[str], list[str]]

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], _byte_chars()
        byte_ids = np.zeros(256, np.int64)
        strings = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            strings[i] = bytes(chars[c] for c in token)
            if len(token) == 1:
                byte_ids[chars[token]] = i
        for t in spec["added_tokens"]:
            strings[t["id"]] = t["content"].encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        pairs = left << 32 | right
        order = np.argsort(pairs, kind="stable")
        lowest = np.full(len(strings), len(pairs), np.int64)
        np.minimum.at(lowest, np.concatenate([left, right]), np.tile(np.arange(len(pairs)), 2))
        added = {t["content"]: np.uint32(t["id"]).tobytes() for t in spec["added_tokens"]}
        split = re.compile("(" + ("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)") + ")").split
        return cls(byte_ids, pairs[order], order.astype(np.int64), merged[order], lowest[merged] > np.arange(len(pairs)), strings, added,
                   split)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, merged id) of each pair."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        hit = self.pairs[at] == want
        return np.where(hit, self.ranks[at], -1), self.merged[at]


def _encode_group(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int
                  ) -> list[bytes]:
    """Ids of pieces of at most ``width`` bytes (a power of two)."""
    n = len(starts)
    col = np.arange(width)
    live = col[None, :] < sizes[:, None]
    sym = np.full((n, width), -1, np.int64)
    sym[live] = vocab.byte_ids[data[(starts[:, None] + col[None, :])[live]]]
    nxt = np.broadcast_to(col + 1, (n, width)).copy()
    prv = np.broadcast_to(col - 1, (n, width)).copy()
    nxt[nxt >= sizes[:, None]] = -1
    tree = np.full((n, 2 * width), _NONE)
    if width > 1:
        row, i = np.nonzero(live[:, 1:])
        rank, _ = vocab.look(sym[row, i], sym[row, i + 1])
        tree[row, width + i] = np.where(rank >= 0, rank << 32 | i, _NONE)
    level = width // 2
    while level:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        level //= 2

    def set_leaves(rows: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = key
        while node[0] > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair_key(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = nxt[rows, at]
        rank, _ = vocab.look(sym[rows, at], sym[rows, np.maximum(after, 0)])
        return np.where((after >= 0) & (rank >= 0), rank << 32 | at, _NONE)

    def places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the merges of one step, from left to right in each row."""
        rank = tree[rows, 1] >> 32
        many = vocab.safe[rank]
        if width <= BATCHED or not many.any():
            return rows, tree[rows, 1] & 0xFFFFFFFF
        r, node, rank = rows[many], np.ones(int(many.sum()), np.int64), rank[many]
        for _ in range(width.bit_length() - 1):
            r, rank = np.repeat(r, 2), np.repeat(rank, 2)
            node = (2 * node[:, None] + np.arange(2)).ravel()
            on = tree[r, node] >> 32 == rank
            r, node, rank = r[on], node[on], rank[on]
        at = node - width
        linked = np.zeros(len(at), bool)  # shares a symbol with the place before it
        linked[1:] = (r[1:] == r[:-1]) & (nxt[r[:-1], at[:-1]] == at[1:])
        i = np.arange(len(at))
        free = (i - np.maximum.accumulate(np.where(linked, 0, i))) % 2 == 0
        alone = rows[~many]
        return np.concatenate([r[free], alone]), np.concatenate([at[free], tree[alone, 1] & 0xFFFFFFFF])

    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        r, at = places(rows)
        gone = nxt[r, at]
        _, merged = vocab.look(sym[r, at], sym[r, gone])
        sym[r, at] = merged
        sym[r, gone] = -1
        after = nxt[r, gone]
        nxt[r, at] = after
        some = after >= 0
        prv[r[some], after[some]] = at[some]
        before = prv[r, at]
        some = before >= 0
        r_set, at_set = np.concatenate([r, r[some]]), np.concatenate([at, before[some]])
        set_leaves(np.concatenate([r, r_set]), np.concatenate([gone, at_set]),
                   np.concatenate([np.full(len(r), _NONE), pair_key(r_set, at_set)]))
        rows = rows[tree[rows, 1] < _NONE]
    kept = sym >= 0
    ids = sym[kept].astype("<u4").tobytes()
    ends = 4 * np.cumsum(kept.sum(axis=1))
    begins = [0, *ends[:-1].tolist()]
    return [ids[a:b] for a, b in zip(begins, ends.tolist())]


def encode_pieces(vocab: Vocabulary, pieces: list[str]) -> list[bytes]:
    """Ids of each piece, as little-endian uint32 bytes."""
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    sizes = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.cumsum(sizes) - sizes
    out: list[bytes] = [b""] * len(raw)
    width, least = 4, 0
    while least < (int(sizes.max()) if len(sizes) else 0):
        some = np.flatnonzero((sizes > least) & (sizes <= width))
        step = max(1, (1 << 19) // width)
        for a in range(0, len(some), step):
            part = some[a:a + step]
            for i, ids in zip(part.tolist(), _encode_group(vocab, data, starts[part], sizes[part], width)):
                out[i] = ids
        least, width = width, 2 * width
    return out


def pieces(vocab: Vocabulary, text: str) -> list[str]:
    """The pieces of a text that merges do not leave; special tokens are pieces of their own."""
    out: list[str] = []
    for part in vocab.split(text) if "<|" in text else [text]:
        if part in vocab.added:
            out.append(part)
        else:
            out += (_FIND_ASCII if part.isascii() else _FIND)(part)
    return out


def encode_texts(vocab: Vocabulary, texts: list[str]) -> list[bytes]:
    """Ids of each text, as little-endian uint32 bytes."""
    cut = [pieces(vocab, t) for t in texts]
    new = list(set().union(*cut).difference(vocab.added))
    ids = {**vocab.added, **dict(zip(new, encode_pieces(vocab, new)))}
    return [b"".join(map(ids.__getitem__, p)) for p in cut]


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The UTF-8 text of ids; bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(map(vocab.strings.__getitem__, ids.tolist()))
    return raw.decode("utf-8", "replace").encode()


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.load(path)
    return _VOCABULARIES[path]


def _passing(docs: DataFrame, drop: str, add: list[tuple[str, str, pa.DataType]], column: str, work) -> DataFrame:
    """``docs`` without ``drop``, with the columns that ``work`` makes from batches of ``column``."""
    names = [x[0] for x in add]
    rest = [c for c in docs.columns if c != drop and c not in names]
    schema = docs.select(*rest).schema
    for name, kind, _ in add:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(rest))
            for a, b in text_chunks(values):
                made = work(values.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(rest))]
                    + [pa.array(x, t) for x, (_, _, t) in zip(made, add)], names=[*rest, *names])

    return docs.select(*rest, column).mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without ``text``, with ``ids``: binary, little-endian uint32. A null text is the
    empty one and has no ids; repeated rows and null ids pass through."""
    path = path or public_path("byte_bpe_50k.json")

    def work(values: pa.Array):
        return [as_bytes(*tree_encoder(path).encode(values))]

    return _passing(docs, text, [("ids", "binary", pa.binary())], text, work)


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` without ``ids``, with ``text`` decoded from it (null ids: the empty text)."""
    path = path or public_path("byte_bpe_50k.json")

    def work(values: pa.Array):
        vocab = vocabulary(path)
        return [[decode_ids(vocab, np.frombuffer(x or b"", "<u4")).decode() for x in values.to_pylist()]]

    return _passing(docs, ids, [("text", "string", pa.string())], ids, work)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded and its ids
    decoded again, in one pass over the batch, so that ids and texts never leave the worker."""
    path = path or public_path("byte_bpe_50k.json")

    def work(values: pa.Array):
        ids = as_bytes(*tree_encoder(path).encode(values))
        vocab = vocabulary(path)
        texts = [decode_ids(vocab, np.frombuffer(x, "<u4")) for x in ids]
        return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(x).hexdigest() for x in texts]]

    return _passing(docs.select(id_col, text), text,
                    [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()),
                     ("decoded_sha256", "string", pa.string())], text, work)
