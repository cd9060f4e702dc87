"""Words of a batch of texts as numpy arrays, without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+``. UTF-8 keeps those separators as single bytes,
so words are found in the Arrow buffer of the whole batch at once.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Longer words are hashed one by one.
_LONG = 256


@dataclass
class Words:
    """``data``: the bytes of all texts; ``offsets``: where each text starts (and the end of
    the last); ``starts``/``ends``: byte spans of words; ``first``: index of each text's first
    word (and the number of words)."""
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """The text's index, for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(column: pa.Array) -> Words:
    data, offsets = buffers(column)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:len(data)]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:len(data)]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step over all spans."""
    sizes = ends - starts
    h = mix(sizes.astype(np.uint64) * _M1 + _M3)
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    todo = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
    at = 0
    while len(todo):
        left = sizes[todo] - at
        lane = eights[starts[todo] + at]
        short = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
        h[todo] = mix((h[todo] ^ ((lane << short) >> short)) * _M1 + _M2)
        at += 8
        todo = todo[left > 8]
    long = np.flatnonzero(sizes > _LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return h


def hash_words(words: Words) -> np.ndarray:
    return hash_spans(words.data, words.starts, words.ends)


def rolling(hashes: np.ndarray, size: int, base: int = 0x2545F4914F6CDD1B) -> np.ndarray:
    """Polynomial hash of every window of ``size`` consecutive items (the last
    size - 1 entries are missing); the window's text border is the caller's."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, b = hashes[:n].copy(), np.uint64(base)
    for i in range(1, size):
        out *= b
        out += hashes[i:i + n]
    return out


def window_ok(words: Words, size: int) -> np.ndarray:
    """For each window start of ``rolling``: whether it lies within one text."""
    n = len(words.starts) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    doc = words.doc_of()
    return doc[:n] == doc[size - 1:]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ..., start + size - 1 of all ranges, in a row."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - begin, sizes)


def normalized(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the words of all texts with one space between them
    (also between texts), so that a run of words is one byte span."""
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = words.data[~SPACE[words.data]]  # the bytes of words, in order
    return out, ends - sizes, ends
