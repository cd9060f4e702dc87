"""Quality rules by repetition coverage.

For each text the share of its characters that lie inside repeated n-grams (several
lengths) and repeated lines is measured, next to a few base counts. N-grams are
found by rolling hashes over word hashes: one multiply-add per word takes every
window from length n to n + 1, and a sort of the text-salted hashes shows which
occur again. One pass over the batch's Arrow buffer, no shuffle: each text is judged
by itself, so the plan is a scan and one Arrow stage.

Definitions: a word is ``[^\\x20\\x09-\\x0D]+``; characters are code points in words. An
n-gram is repeated if the same n words stand earlier in the text; coverage counts each
character once, however many repeated n-grams hold it. A line is a ``\\n``-split part
with at least one word; it is a repeat if it equals an earlier one. What stands twice only
(a header and its one return) counts half: the verdict takes the mean of two coverages, by
all repeats (``dup_..._chars``) and by those of n-grams or lines that stand three times or
more (``many_..._chars``). Equality is by 64-bit hashes within one text (two different
windows of a text of 20,000 words meet with a chance of about 1e-11).

Null and empty texts have no words and fail the base rule; a null id is carried
along; repeated rows are judged one by one; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deadwire.llm.common import text_chunks, tidy
from deadwire.llm.words import Words, hash_words, mix, split_words, window_ok

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityRules:
    """``ngrams``: the largest allowed percentage of characters in repeated n-grams, by n;
    ``lines``: the same in repeated lines; ``min_words`` and ``repeat_percent`` (words in
    windows of ``repeat_window`` words that occur twice or more) are the base rule. The
    defaults are the limits published for web pages, for texts of every length."""
    ngrams: dict[int, int] = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    lines: int = 20
    min_words: int = 20
    repeat_window: int = 8
    repeat_percent: int = 30


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the ranges first[i]:first[i + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _covered(flags: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Words inside a flagged window of ``size`` words."""
    edge = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(flags)
    edge[at] += 1
    edge[at + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def _repeats(keys: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows whose key occurs twice or more, those that are not the first of their key, and
    of these the ones whose key occurs three times or more)."""
    both, later, many = (np.zeros(len(keys), bool) for _ in range(3))
    at = np.flatnonzero(ok)
    if not len(at):
        return both, later, many
    inside = keys[at]
    ordered = np.sort(inside)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return both, later, many
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    slot = np.minimum(np.searchsorted(twice, inside), len(twice) - 1)
    hit = np.flatnonzero(twice[slot] == inside)
    both[at[hit]] = True
    _, firsts, of, times = np.unique(slot[hit], return_index=True, return_inverse=True, return_counts=True)
    later[at[hit]] = True
    later[at[hit[firsts]]] = False
    many[at[hit]] = times[of] > 2
    return both, later, many & later


def _lines(words: Words, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repeated lines, characters in their words, and in those of lines that stand three times
    or more) of each text."""
    n = len(words.offsets) - 1
    count, held, often = (np.zeros(n, np.int64) for _ in range(3))
    breaks = np.flatnonzero(words.data == 0x0A)
    starts = np.union1d(words.offsets[:-1], breaks + 1)
    starts = starts[starts < len(words.data)]
    if not len(starts):
        return count, held, often
    doc = np.searchsorted(words.offsets, starts, side="right") - 1
    stops = np.append(starts[1:], len(words.data))
    stops = stops - (words.data[stops - 1] == 0x0A)
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, stops)
    keep = last > first
    starts, stops, doc, first, last = (x[keep] for x in (starts, stops, doc, first, last))
    view = memoryview(np.ascontiguousarray(words.data))
    keys = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist())),
                       np.uint64, len(starts))
    _, later, many = _repeats(mix(keys ^ mix(doc.astype(np.uint64))), np.ones(len(keys), bool))
    total = np.concatenate([[0], np.cumsum(chars)])
    size = total[last] - total[first]
    np.add.at(count, doc[later], 1)
    np.add.at(held, doc[later], size[later])
    np.add.at(often, doc[many], size[many])
    return count, held, often


def measure(column: pa.Array, rules: QualityRules) -> dict[str, np.ndarray]:
    """The measures of each text of a string column."""
    words = split_words(column)
    n, n_words = len(words.offsets) - 1, len(words.starts)
    points = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=points[1:])
    chars = points[words.ends] - points[words.starts]
    out = {"n_words": words.counts.astype(np.int64), "word_chars": _sums(chars, words.first),
           "n_symbols": _sums(_SYMBOL[words.data], words.offsets)}
    out["n_dup_lines"], out["dup_line_chars"], out["many_line_chars"] = _lines(words, chars)
    hashes = hash_words(words)
    salt = mix(words.doc_of().astype(np.uint64) + np.uint64(1))
    run, base = hashes.copy(), np.uint64(0x2545F4914F6CDD1B)
    wanted = sorted({*rules.ngrams, rules.repeat_window})
    out["n_repeat_words"] = np.zeros(n, np.int64)
    for size in range(2, max(wanted) + 1):
        run = run[:max(0, n_words - size + 1)]
        run *= base
        run += hashes[size - 1:size - 1 + len(run)]
        if size not in wanted:
            continue
        both, later, many = _repeats(mix(run ^ salt[:len(run)]), window_ok(words, size))
        if size == rules.repeat_window:
            out["n_repeat_words"] = _sums(_covered(both, size, n_words), words.first)
        if size in rules.ngrams:
            for name, flags in (("dup", later), ("many", many)):
                out[f"{name}_{size}gram_chars"] = _sums(_covered(flags, size, n_words) * chars, words.first)
    return out


def quality(docs: DataFrame, text: str = "text", rules: QualityRules | None = None,
            keep_text: bool = False) -> DataFrame:
    """``docs`` without ``text`` (unless ``keep_text``), with the measures, ``base_failed`` and ``kept``
    (columns of ``docs`` of the same names give way)."""
    rules = rules or QualityRules()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "many_line_chars", "n_repeat_words",
             *(f"{x}_{n}gram_chars" for n in sorted(rules.ngrams) for x in ("dup", "many"))]
    rest = [c for c in docs.columns if (keep_text or c != text) and c not in {*names, "base_failed", "kept"}]

    judged = rest.index(text) if keep_text else len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            column = batch.column(judged)
            for a, b in text_chunks(column):
                found = measure(column.slice(a, b - a), rules)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(rest))]
                    + [pa.array(found[x], pa.int64()) for x in names], names=[*rest, *names])

    schema = docs.select(*rest).schema
    for x in names:
        schema = schema.add(x, "long")
    out = docs.select(*rest, *([] if keep_text else [text])).mapInArrow(run, schema)
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    fits = F.lit(True)
    for what, percent in [("line", rules.lines), *((f"{n}gram", p) for n, p in sorted(rules.ngrams.items()))]:
        fits &= 50 * (F.col(f"dup_{what}_chars") + F.col(f"many_{what}_chars")) <= percent * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fits)
