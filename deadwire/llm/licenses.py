"""License scans by conditional compression.

A template is looked for by its words, so line breaks, comment marks and indentation between them do not matter. It can
stand at a place of a text only if one of the pieces it falls into stands there unchanged (there is
one piece more than words that may change), so every place with such a piece is looked at, anywhere in the whole text;
the words around these places are the candidate blocks. The words of the place are compressed alone and with the
template as zstandard raw dictionary: the closer the wording, the more bytes are saved. That
saving ranks the templates that want the same words and drops none. Each place is confirmed by an exact
word comparison in that order: the template must stand there with few word differences, none
of which may touch a version, a number or a term that changes the license (NC, ND, SA, LGPL ...).

One Arrow stage per table, no shuffle: a document is judged by itself. Templates are a
parameter; the defaults are short public notices, headers and SPDX lines. A text's words take some 100 bytes each
while it is looked at, which is done only if it holds a word of some piece.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from deadwire.llm.common import text_chunks

#: Public license notices (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
                   "except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or"),
    ("LGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or"),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    *((name, f"SPDX-License-Identifier: {name}") for name in (
        "Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0")),
)
_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*|[-+]", re.ASCII | re.IGNORECASE)
#: Words whose presence or absence changes the license.
CRITICAL = frozenset("nc nd sa by gpl lgpl agpl lesser affero gnu mit apache bsd mozilla cc not no only".split())
#: Words that may be lacking, and as many that may be added, as a share of the template's words.
MAX_CHANGES = 0.1


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """(lower-case word or number, start, end in characters); hyphens only count inside a term."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text) if m[0] not in "-+"]


def words_of(text: str) -> list[str]:
    return [w for w, _, _ in placed_words(text)]


def fixed(word: str) -> bool:
    """Whether a change of the word changes the license."""
    return word in CRITICAL or word[0].isdigit()


def pieces(template: list[str], changes: int) -> list[tuple[int, str]]:
    """(first word, text) of 2 * changes + 1 pieces: ``changes`` lacking and as many added words
    leave one of them whole."""
    n = 2 * changes + 1
    cuts = [len(template) * i // n for i in range(n + 1)]
    return [(a, " " + " ".join(template[a:b]) + " ") for a, b in zip(cuts, cuts[1:])]


def seeds(joined: str, starts: list[int], parts: list[tuple[int, str]]) -> list[int]:
    """Where in the block (in words) the template would begin, by each piece that stands in it.
    ``joined``: the words, each between single spaces; ``starts``: the space before each."""
    out = set()
    for first, part in parts:
        at = joined.find(part)
        while at >= 0:
            out.add(bisect_left(starts, at) - first)
            at = joined.find(part, at + 1)
    return sorted(out)


def _walk(block: list[str], template: list[str], start: int, head: int,
          changes: int) -> tuple[list[str], list[str], int, int] | None:
    """The template from its word ``head`` on (those before lack) with its first word on word ``start`` of the
    block. A cell holds the fewest lacking words: place and lacking words together give the added ones."""
    size = len(template)
    rows: list[dict[int, tuple[int, int, str]]] = [{start: (head, start, "")}]  # end in the block: lacking, from, step
    for i in range(head, size):
        row, below = rows[-1], {}
        for j in sorted(row) if i > head else []:  # an added word
            while j < len(block) and not fixed(block[j]):
                lost = row[j][0]
                if (j + 1 in row and row[j + 1][0] <= lost) or j + 1 - start - i + lost > changes:
                    break
                row[j + 1] = (lost, j, "add")
                j += 1
        for j, (lost, _, _) in row.items():
            if j < len(block) and block[j] == template[i] and (j + 1 not in below or lost < below[j + 1][0]):
                below[j + 1] = (lost, j, "match")
            if i > head and lost < changes and not fixed(template[i]) and (j not in below or lost + 1 < below[j][0]):
                below[j] = (lost + 1, j, "lack")
        if not below:
            return None
        rows.append(below)
    at = min(rows[-1], key=lambda j: (2 * rows[-1][j][0] + j, j))
    end, i, lacks, adds, tail = at, size, [], [], 0
    while i > head or rows[i - head][at][2] == "add":
        _, came, step = rows[i - head][at]
        if step == "add":
            adds.append(block[came])
        else:
            if step == "lack":
                lacks.append(template[i - 1])
                tail += len(lacks) == size - i + 1
            i -= 1
        at = came
    # words that stand in place of lacking first or last words
    if any(fixed(w) for w in [*block[max(0, start - head):start], *block[end:end + tail]]):
        return None
    return template[:head] + lacks[::-1], adds[::-1], start, end


def differences(block: list[str], template: list[str], begin: int,
                changes: int) -> tuple[list[str], list[str], int, int] | None:
    """(words the block lacks, words it adds inside the notice, first, end word in the block) where
    the template stands near word ``begin`` with at most ``changes`` lacking and as many added words,
    none of them ``fixed``; None if it does not."""
    near = Counter(block[max(0, begin - changes):begin + len(template) + 2 * changes])
    if sum(min(n, near[w]) for w, n in Counter(template).items()) < len(template) - changes:
        return None
    allowed = 0
    while True:
        made = []
        for start in range(max(0, begin - allowed), min(len(block), begin + allowed + 1)):
            for head in range(min(allowed + 1, len(template))):
                if block[start] == template[head]:
                    made.append(_walk(block, template, start, head, allowed))
                if fixed(template[head]):
                    break
        made = [x for x in made if x]
        if made or allowed == changes:
            return min(made, key=lambda x: (len(x[0]) + len(x[1]), x[2], x[3]), default=None)
        allowed = min(changes, max(1, 2 * allowed))


def scan_text(text: str, prepared) -> tuple[int, list[dict]]:
    """(candidate blocks, findings) of one whole text."""
    templates, plain, rare = prepared
    if not text or rare.search(text) is None:
        return 0, []
    placed = placed_words(text)
    words = [w for w, _, _ in placed]
    joined = " " + " ".join(words) + " "
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    places, around = [], []
    for t, made in enumerate(templates):
        size = len(made.words)
        for at in seeds(joined, starts, made.parts):
            held = " ".join(words[max(0, at):at + size]).encode()
            saved = len(plain.compress(held)) - len(made.dictionary.compress(held))
            places.append((-saved, t, at))
            around.append((at - made.changes, at + size + 2 * made.changes))
    blocks, reach = 0, None
    for a, b in sorted(around):
        blocks += reach is None or a > reach
        reach = b if reach is None else max(reach, b)
    found = []
    taken: list[tuple[int, int]] = []
    for saved, t, at in sorted(places):
        made = templates[t]
        diff = differences(words, made.words, at, made.changes)
        if diff is None:
            continue
        spot = bisect_left(taken, (diff[2], diff[3]))
        if (spot and taken[spot - 1][1] > diff[2]) or (spot < len(taken) and taken[spot][0] < diff[3]):
            continue
        taken.insert(spot, (diff[2], diff[3]))
        found.append({"license": made.name, "start": placed[diff[2]][1], "end": placed[diff[3] - 1][2],
                      "gain": round(-saved / made.alone, 4), "lacks": diff[0], "adds": diff[1]})
    return blocks, found


class Template(NamedTuple):
    """A notice; ``alone`` are its compressed bytes without a dictionary."""
    name: str
    words: list[str]
    changes: int
    parts: list[tuple[int, str]]
    dictionary: zstandard.ZstdCompressor
    alone: int


def prepare(templates: tuple[tuple[str, str], ...] = TEMPLATES):
    """(templates, plain compressor, pattern that every text with a piece of a template matches)"""
    plain, out = zstandard.ZstdCompressor(level=19, write_content_size=False), []
    for name, text in templates:
        words = words_of(text)
        raw = " ".join(words).encode()
        if not words:
            continue
        changes = int(MAX_CHANGES * len(words))
        made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(Template(name, words, changes, pieces(words, changes), zstandard.ZstdCompressor(
            level=19, write_content_size=False, dict_data=made), len(plain.compress(raw))))
    longest = {max(part.split(), key=len, default="") for made in out for _, part in made.parts}
    return out, plain, re.compile("|".join(map(re.escape, sorted(longest, key=lambda w: (-len(w), w)))), re.ASCII | re.IGNORECASE)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
         templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(id, n_blocks, findings): every document with its candidate blocks and the confirmed places of
    licenses (license, start and end of the notice in characters, gain, the words it lacks and adds), wherever they
    stand and however their lines are broken. The gain is the saving at the place as a share of the template's own compressed size.

    Null and empty texts have none; null ids and repeated rows come back as they are;
    other columns are ignored. Of places that overlap the one that saves more is taken, then in template order."""
    finding = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()),
                            T.StructField("end", T.LongType()), T.StructField("gain", T.DoubleType()),
                            T.StructField("lacks", T.ArrayType(T.StringType())),
                            T.StructField("adds", T.ArrayType(T.StringType()))])
    schema = T.StructType([docs.schema[id_col], T.StructField("n_blocks", T.LongType()),
                           T.StructField("findings", T.ArrayType(finding))])
    arrow = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                ("gain", pa.float64()), ("lacks", pa.list_(pa.string())),
                                ("adds", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = prepare(templates)
        for batch in batches:
            for a, b in text_chunks(batch.column(1)):
                made = [scan_text(t, prepared) for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([x[0] for x in made], pa.int64()),
                     pa.array([x[1] for x in made], arrow)], names=[id_col, "n_blocks", "findings"])

    return docs.select(id_col, text).mapInArrow(run, schema)
