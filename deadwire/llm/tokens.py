"""Token ids of whole texts, with one bounded cache of text units per worker process.

Both public vocabularies first cut a text into pieces (words with their space, runs of
punctuation ...) and merge inside a piece only. So a text may be cut at any place where a
piece must begin, whatever stands around, and its ids are the joined ids of those units:

* byte-level: before a space that a character other than white space follows. White space before it
  ends a piece there (a run of it leaves its last space to the next word), and so does
  anything else; and around a single line end between ASCII characters;
* word vocabulary: at white space, which is dropped;
* both: before a mark of ``_MARKS`` that follows a letter (of ASCII or Latin-1).

Units are found and hashed on the Arrow buffer (no Python object per unit); only units
that the worker has not met lately are encoded. Two different units would have to meet in
64 bits of hash to be taken for one another.
"""
from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from deadwire.llm.words import SPACE, buffers, hash_spans, split_words, spread

#: Units of each of the two generations that a worker holds.
CACHE_UNITS = 250_000
#: Longer units are not held.
CACHE_UNIT_IDS = 64

#: What may begin white space: its ASCII bytes and the lead bytes of the other white space.
_MAY_BE_SPACE = SPACE.copy()
_MAY_BE_SPACE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


#: Marks that no special token holds.
_MARKS, _LETTER, _LATIN = (np.zeros(256, bool) for _ in range(3))
_MARKS[list(b".,;:!?()")] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True  # after C3: all but the signs of x and /


def _marks(data: np.ndarray) -> np.ndarray:
    """Where a mark follows a letter."""
    out = _MARKS[data]
    letter = _LETTER[data]
    letter[1:] |= _LATIN[data[1:]] & (data[:-1] == 0xC3)
    out[1:] &= letter[:-1]
    out[:1] = False
    return out


def public_path(name: str) -> str:
    """Where the public tokenizer file lies; the folder is a parameter of the host
    (``DEADWIRE_TOKENIZERS``), by default that of the installed package."""
    folder = os.environ.get("DEADWIRE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def load_library(path: str):
    """The tokenizers library's object, without the file's truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def is_byte_level(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["pre_tokenizer"]["type"] == "ByteLevel"


def byte_level_units(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(bytes, starts, ends, first unit of each text) of units that begin with their space."""
    data, offsets = buffers(column)
    begins = data == 0x20
    begins[:-1] &= ~_MAY_BE_SPACE[data[1:]]
    begins |= _marks(data)
    line = np.zeros(len(data), bool)
    plain = ~_MAY_BE_SPACE[data] & (data < 0x80)
    line[1:-1] = (data[1:-1] == 0x0A) & plain[:-2] & plain[2:]
    begins |= line
    begins[1:] |= line[:-1]
    sizes = np.diff(offsets)
    begins[offsets[1:][sizes > 0] - 1] = False
    begins[offsets[:-1][sizes > 0]] = True
    starts = np.flatnonzero(begins)
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def word_units(column: pa.Array) -> tuple[np.ndarray, ...]:
    words = split_words(column)
    begins, stops = _marks(words.data), np.zeros(len(words.data) + 1, bool)
    stops[:-1] = begins
    begins[words.starts] = stops[words.ends] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return words.data, starts, ends, np.searchsorted(starts, words.offsets)


class _Held:
    """Ids of units by their hash."""

    def __init__(self) -> None:
        self.slot: dict[int, int] = {}
        self.starts, self.sizes, self.ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        self.end = 0

    def add(self, keys: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = sum(map(len, self.sizes)) if len(self.sizes) > 1 else len(self.sizes[0])
        self.slot.update(zip(keys, range(n, n + len(keys))))
        self.starts.append(np.cumsum(sizes) - sizes + self.end)
        self.sizes.append(sizes)
        self.ids.append(ids)
        self.end += len(ids)

    def get(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, all ids) of slots."""
        self.starts, self.sizes, self.ids = ([np.concatenate(x)] for x in (self.starts, self.sizes, self.ids))
        return self.starts[0][slots], self.sizes[0][slots], self.ids[0]


class UnitEncoder:
    """``encode(column)`` gives (ids of all texts, number of ids of each text)."""

    def __init__(self, units: Callable, encode_new: Callable[[list[str]], list[bytes]]):
        self.units, self.encode_new = units, encode_new
        self.now, self.old = _Held(), _Held()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, starts, ends, first = self.units(column)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(first) - 1, np.int64)
        keys, where, back = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.now.slot) > CACHE_UNITS:
            self.old, self.now = self.now, _Held()
        now, listed = self.now, keys.tolist()
        slots = np.array(list(map(now.slot.get, listed, (-1,) * len(listed))), np.int64)
        lack = np.flatnonzero(slots < 0)
        if len(lack):
            before = np.array([self.old.slot.get(listed[i], -1) for i in lack.tolist()], np.int64)
            again, lack = lack[before >= 0], lack[before < 0]
            if len(again):
                at, sizes, ids = self.old.get(before[before >= 0])
                now.add([listed[i] for i in again.tolist()], sizes, ids[spread(at, sizes)])
            if len(lack):
                raw = data.tobytes()
                a, b = starts[where[lack]].tolist(), ends[where[lack]].tolist()
                made = self.encode_new([raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(a, b)])
                sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
                now.add([listed[i] for i in lack.tolist()], sizes, np.frombuffer(b"".join(made), np.uint32))
            slots = np.array(list(map(now.slot.__getitem__, listed)), np.int64)
        at, sizes, ids = now.get(slots)
        per_unit = sizes[back]
        out = ids[spread(at[back], per_unit)]
        total = np.concatenate([[0], np.cumsum(per_unit)])
        if len(lack):
            for i in lack[sizes[lack] > CACHE_UNIT_IDS].tolist():
                del now.slot[listed[i]]
        return out, total[first[1:]] - total[first[:-1]]


def library_units(path: str, together: int = 128) -> Callable[[list[str]], list[bytes]]:
    """Ids of units by the tokenizers library. Units that are one piece of letters are handed over ``together`` in
    one text (its pre-tokenizer parts them again, which the word numbers confirm), others one by one."""
    tok = load_library(path)
    byte_level = is_byte_level(path)
    between = "" if byte_level else " "

    def alone(units: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(units, add_special_tokens=False)]

    def encode(units: list[str]) -> list[bytes]:
        plain = [x for x in units if (x[0] == " " and x[1:].isalpha() if byte_level else x.isalpha())]
        found: dict[str, bytes] = {}
        parts = [plain[i:i + together] for i in range(0, len(plain), together)]
        for part, e in zip(parts, tok.encode_batch([between.join(x) for x in parts], add_special_tokens=False)):
            counts = np.bincount(e.word_ids, minlength=len(part))
            if len(counts) != len(part) or not counts.all():
                continue
            ids = array("I", e.ids).tobytes()
            ends = (4 * np.cumsum(counts)).tolist()
            found.update(zip(part, (ids[i:j] for i, j in zip([0, *ends], ends))))
        rest = [x for x in units if x not in found]
        found.update(zip(rest, alone(rest)))
        return [found[x] for x in units]

    return encode


_ENCODERS: dict[tuple[str, str], UnitEncoder] = {}


def library_encoder(path: str) -> UnitEncoder:
    """This process's encoder of one vocabulary by the library."""
    key = ("library", path)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(byte_level_units if is_byte_level(path) else word_units, library_units(path))
    return _ENCODERS[key]


def tree_encoder(path: str) -> UnitEncoder:
    """This process's encoder of one byte-level vocabulary by segment trees."""
    from deadwire.llm.bpe import encode_texts, vocabulary
    key = ("tree", path)
    if key not in _ENCODERS:
        vocab = vocabulary(path)
        _ENCODERS[key] = UnitEncoder(byte_level_units, lambda units: encode_texts(vocab, units))
    return _ENCODERS[key]


def as_bytes(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The ids of each text as little-endian uint32 bytes."""
    raw = ids.astype("<u4", copy=False).tobytes()
    ends = (4 * np.cumsum(counts)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]
