"""Each operator against its brute-force version: small tables with the awkward cases, and the
driver's sf0.001 tables whole."""
import hashlib
import json
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brute
from deadwire.llm import (bpe, chat, embeddings, licenses, packing, quality, queries, simhash, substring,
                          token_files, tokens, warc)
from deadwire.llm.common import join_back, table, work_dir
from deadwire.llm.components import components

SF = "/root/testdata/sf0.001"

rng = random.Random(7)
LEXICON = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(LEXICON) + (".\n" if r.random() < 0.05 else "") for _ in range(n))


PASSAGE, COMMON = prose(45, "passage"), prose(30, "common")
TEXTS = [
    None, "", "   \n\t ", "one", "one two three", prose(400, 1), prose(400, 1), prose(400, 1) + " end",
    prose(30, 2) + " " + PASSAGE + " " + prose(50, 3), prose(3, 4) + "\n" + PASSAGE, PASSAGE + " " + PASSAGE,
    COMMON + "\n" + COMMON + "\n" + COMMON, "a " * 300, "x" * 5000, "Wort " + "é" * 700 + " # $ | <tag> & %",
    "The QUICK Brown Fox\x0bjumps\x0cover\rthe\tdog\x1c again", "line one\nline one\nline two\n\nline one",
    "<|endoftext|> not special <|im_end|>", "日本語 テスト 😀 emoji", prose(3000, 5), prose(3000, 5)[:-40] + " tail",
    "a b c d e f g h i j k l m n o p q r s t u", "a b c d e f g h i j k l m n o p q r s t u v",
]


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): with repeated rows, repeated ids and null ids."""
    out = [(i, t) for i, t in enumerate(TEXTS)]
    return out + [(5, TEXTS[5]), (8, TEXTS[8]), (8, prose(60, 9)), (None, TEXTS[8]), (None, ""), (-3, PASSAGE)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns clash with names that operators use inside."""
    clash = ["id", "fp", "ids", "th", "start", "n_words", "kept", "length", "task", "anchor", "label", "node", "root"]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clash)
    return spark.createDataFrame([(*r, *clash) for r in rows], schema).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def whole(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]


def bag(df, *cols):
    return Counter(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# -- 1 ----------------------------------------------------------------------------------------

LONG = "<p>" + "é" * 600 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u", LONG), (2, None, LONG), (9, "a\r\nWARC-Type: x", LONG), (9, "u", LONG), (None, "u", LONG),
            (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "x" * 999), (8, "u", "x" * 999),
            (10, "u", "x" * 1000), (11, "u", "x" * 1000), (None, "v", "y" * 2000)]
    return rows, spark.createDataFrame([(*r, "d", "p") for r in rows],
                                       "page_id long, url string, html string, digest string, payload string")


def test_warc(spark, pages):
    rows, df = pages
    out = work_dir(spark, "t")
    warc.write_archive(df, out)
    assert bag(warc.read_archive(spark, out)) == Counter(brute.warc([(a, c) for a, _, c in rows]))
    assert spark.read.parquet(f"{out}/payloads").count() == len({c or "" for _, _, c in rows})
    for r in warc.rebuild(spark, out).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == r.record_type
        block = rest[:int(fields["Content-Length"])]
        assert rest[len(block):] == b"\r\n\r\n"
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(bytes(r.payload)).hexdigest()
        if r.record_type == "response":
            assert block.partition(b"\r\n\r\n")[2] == bytes(r.payload)
        else:
            assert block == b"" and fields["WARC-Refers-To"].startswith("<urn:page:")


def test_warc_finds_a_wrong_payload(spark, pages):
    out, bad = work_dir(spark, "t"), work_dir(spark, "t")
    warc.write_archive(pages[1], out)
    spark.read.parquet(f"{out}/payloads").withColumn("payload", F.concat("payload", F.lit("!").cast("binary"))).write.parquet(
        f"{bad}/payloads")
    spark.read.parquet(f"{out}/records").write.parquet(f"{bad}/records")
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read_archive(spark, bad).collect()


def test_warc_empty(spark, pages):
    out = work_dir(spark, "t")
    warc.write_archive(pages[1].limit(0), out)
    assert warc.read_archive(spark, out).count() == 0


# -- 2 ----------------------------------------------------------------------------------------

def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)  # several blocks a label
    r = np.random.default_rng(3)
    centres = r.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + 0.13 * r.standard_normal(16)).astype(float).tolist(), i % 3 if i % 50 else None)
            for i in range(400)]
    rows += [(400 + i, rows[3][1], 0) for i in range(60)] + [(500, rows[3][1], 0), (500, rows[3][1], 0)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, [1.0, None], 1),
             (605, [float("inf")] * 16, 1), (606, [1.0, 0.0], 1), (607, [2.0, -0.0], 1), (608, [1e-300, 0.0], 1),
             (None, rows[3][1], 0), (609, [1e200, 1e200], 1), (610, [1.0, 1.0], 1), (None, None, None)]
    df = spark.createDataFrame([(*x, 1, "r") for x in rows],
                               "vec_id long, embedding array<double>, label int, rep int, root string").repartition(3)
    assert bag(embeddings.near_duplicates(df)) == Counter(brute.embeddings(rows))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    assert bag(queries.op2_embedding_neardup(spark, SF)) == Counter(brute.embeddings(rows))


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(300, 400)] + [(r.randrange(200), r.randrange(200)) for _ in range(120)]
    pairs += [(7, 7), (500, 900), (900, 500)]
    edges = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    root = brute.reachable(1000, pairs)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert bag(components(edges)) == Counter((i, root[i]) for i in linked)
    assert components(edges.limit(0)).count() == 0


# -- 3, 4, 6 ------------------------------------------------------------------------------------

def library_ids(name, texts):
    tok = tokens.load_library(tokens.public_path(name))
    return tok, [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_bpe(spark, docs, rows, empty):
    tok, ids = library_ids("byte_bpe_50k.json", [t for _, t in rows])
    got = bag(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == Counter(
        (d, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(),
         brute.sha(tok.decode(x, skip_special_tokens=False))) for (d, _), x in zip(rows, ids))
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text")))
    assert bag(back, "doc_id", "text") == Counter((d, t or "") for d, t in rows)
    assert bpe.digests(empty).count() == 0


@pytest.mark.parametrize("name,make", [("byte_bpe_50k.json", tokens.tree_encoder),
                                       ("byte_bpe_50k.json", tokens.library_encoder),
                                       ("word_bpe_49k.json", tokens.library_encoder)])
def test_encoders_on_odd_characters(name, make):
    r = random.Random(11)
    pool = [chr(c) for c in [*range(9, 14), *range(28, 130), 0x85, 0xA0, 0x130, 0x3A3, 0x3C2, 0x301, 0x307, 0x345, 0x1680,
                             0x2003, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0x4E00, 0x1F600, 0xAC00, 0x212B, 0xFEFF]]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    texts += ["<|endoftext|>a<|endoftext|>", "<|startoftext|>A <|ENDOFTEXT|>", "ab" * 4000, "'S 'll''s  x"]
    _, want = library_ids(name, texts)
    enc = make(tokens.public_path(name))
    for part in (texts, texts[::-1], texts):  # also when all is held
        got = tokens.as_bytes(*enc.encode(pa.array(part)))
        want = [x for x in (want if part == texts else want[::-1])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
        want = want if part == texts else want[::-1]


def test_bpe_long_pieces():
    """Runs without a break merge many places a step, as the library merges them one by one."""
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * n for n in (31, 32, 33, 63, 64, 65, 1001)] + ["ab" * 500 + "a", "=" * 999, "-=" * 300]
    texts += ["".join(r.choice(letters) for _ in range(n)) for n in (40, 100, 3000, 30000)]
    texts += ["".join(r.choice(LEXICON) for _ in range(4000)), "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(3000))]
    _, want = library_ids("byte_bpe_50k.json", texts)
    vocab = bpe.vocabulary(tokens.public_path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(vocab, texts)] == want


@pytest.mark.parametrize("seed", range(6))
def test_bpe_merges_that_make_lower_ranks(tmp_path, seed):
    """A merge whose symbol stands in a pair of lower rank is taken one place at a time."""
    r = random.Random(seed)
    known, merges = list("abc"), []
    while len(merges) < 14:
        pair = r.choice(known), r.choice(known)
        if "".join(pair) not in known and len("".join(pair)) < 9:
            known.append("".join(pair))
            merges.append(pair)
    r.shuffle(merges)
    chars = bpe._byte_chars()
    table = {t: i for i, t in enumerate([*chars, *(t for t in known if len(t) > 1)])}
    path = tmp_path / "ranks.json"
    path.write_text(json.dumps({"model": {"vocab": table, "merges": [" ".join(m) for m in merges]}, "added_tokens": []}))
    vocab = bpe.Vocabulary.load(str(path))
    assert not vocab.safe.all()
    texts = ["".join(r.choice("abc") for _ in range(n)) for n in (5, 33, 64, 200, 700)]
    for text in texts:
        left = list(text)
        while True:
            found = [(merges.index(p), i) for i, p in enumerate(zip(left, left[1:])) if p in merges]
            if not found:
                break
            i = min(found)[1]
            left[i:i + 2] = [left[i] + left[i + 1]]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(vocab, [text])] == [[table[t] for t in left]]


def test_cache_of_two_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 40)
    path = tokens.public_path("byte_bpe_50k.json")
    enc = tokens.UnitEncoder(tokens.byte_level_units, tokens.library_units(path))
    texts = [prose(30, i % 5) + " " + prose(5, i) + "z" * 200 for i in range(20)]
    _, want = library_ids("byte_bpe_50k.json", texts)
    got = [tokens.as_bytes(*enc.encode(pa.array([t, None, t]))) for t in texts]
    assert [[np.frombuffer(x, "<u4").tolist() for x in g] for g in got] == [[w, [], w] for w in want]


def test_decode_of_ids_that_are_no_text():
    vocab = bpe.vocabulary(tokens.public_path("byte_bpe_50k.json"))
    tok = tokens.load_library(tokens.public_path("byte_bpe_50k.json"))
    r = random.Random(2)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert bpe.decode_ids(vocab, np.array(ids)).decode() == tok.decode(ids, skip_special_tokens=False)


def test_token_files(spark, docs, rows, empty):
    _, ids = library_ids("word_bpe_49k.json", [t for _, t in rows])
    out = work_dir(spark, "t")
    token_files.write_tokens(docs, out)
    read = token_files.read_tokens(spark, out).join(token_files.block_starts(spark, out), ["file_no", "block_no"])
    got = [(r.block_start + r.inner, r.doc_id, r.n_tokens, bytes(r.ids)) for r in read.collect()]
    got.sort(key=lambda x: x[0])
    assert Counter((d, x) for _, d, _, x in got) == Counter(
        (d, np.array([*x, 1], "<u4").tobytes()) for (d, _), x in zip(rows, ids))
    assert [x[0] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1].tolist()]
    order = [d for _, d, _, _ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert sorted(token_files.read_document(spark, out, 8)) == sorted(
        [*x, 1] for (d, _), x in zip(rows, ids) if d == 8)
    assert spark.read.parquet(f"{out}/blocks").select("dictionary").distinct().count() == 1
    blank = work_dir(spark, "t")
    token_files.write_tokens(empty, blank)
    assert token_files.read_tokens(spark, blank).count() == 0


def test_token_files_query(spark, whole):
    _, ids = library_ids("word_bpe_49k.json", [t for _, t in whole])
    at, want = 0, []
    for (d, _), x in sorted(zip(whole, ids), key=lambda p: p[0][0]):
        want.append((d, at, len(x) + 1, brute.crc([*x, 1])))
        at += len(x) + 1
    assert bag(queries.op4_token_files(spark, SF)) == Counter(want)


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 1300, 5000])
def test_lengths(n):
    got = packing.lengths(n)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 1024 for x in got)
    assert len([x for x in got if x < 1024]) == bin(n % 1024).count("1")


def test_packing(spark, docs, rows, empty):
    _, ids = library_ids("byte_bpe_50k.json", [t for _, t in rows])
    want = Counter()
    for (d, _), x in zip(rows, ids):
        x, at = [*x, 0], 0
        for size in packing.lengths(len(x)):
            want[(d, at, size, len(x), 0, brute.crc(x[at:at + size]))] += 1
            at += size
    got = packing.pack(docs, keep_ids=False)
    assert bag(got, "doc_id", "start", "length", "doc_tokens", "offset", "ids_crc32") == want
    numbers = [(r.sequence_id, r.length) for r in got.collect()]
    assert sorted(n for n, _ in numbers) == list(range(len(numbers)))
    by_number = [size for _, size in sorted(numbers)]
    assert by_number == sorted(by_number, reverse=True)  # a bucket is one range
    held = packing.pack(docs).select("length", F.length("ids").alias("n")).collect()
    assert all(r.n == 4 * r.length for r in held)
    assert packing.pack(empty).count() == 0


# -- 5 ----------------------------------------------------------------------------------------

def test_quality(docs, rows, empty):
    got = quality.quality(docs)
    names = list(brute.quality(""))
    assert bag(got, "doc_id", *names) == Counter((d, *brute.quality(t).values()) for d, t in rows)
    assert "label" in got.columns and quality.quality(empty).count() == 0


def test_quality_limits(spark):
    """A long page with a third of its characters in repeated short lines goes; a header that returns once does not."""
    menu = "".join(prose(9, i).replace("\n", " ") + ("\nReply Share Report abuse\n" if i % 2 else "\nsee more\n") for i in range(200))
    header = "Weekly notes of the town council for residents\n"
    once = header + prose(25, 1) + "\n" + header + prose(25, 2)
    docs = spark.createDataFrame([(1, menu), (2, once), (3, prose(3000, 3)), (4, header * 2 + prose(40, 4) + "\n" + header)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert 20 < 100 * got[1].dup_line_chars / got[1].word_chars < 40 and not got[1].base_failed
    assert [got[i].kept for i in (1, 2, 3)] == [False, True, True]
    assert 0 < got[2].dup_line_chars and got[2].many_line_chars == 0 and got[4].many_line_chars == got[4].dup_line_chars


def test_quality_table(spark, whole):
    names = list(brute.quality(""))
    assert bag(queries.op5_quality(spark, SF), "doc_id", *names) == Counter(
        (d, *brute.quality(t).values()) for d, t in whole)


# -- 7 ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("text,want", [
    ("words\nReleased under the MIT License.\nmore", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 1.1.", []),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("This work is licensed under the GNU General\nPublic License, version 2.", ["GPL-2.0"]),
    ("THIS WORK IS LICENSED UNDER THE GNU LESSER GENERAL PUBLIC LICENSE, VERSION 3", ["LGPL-3.0"]),
    ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0", "MIT"]),
    ("She had a driving licence and a fishing licence.", []), ("", []), (None, []), ("no notice at all", []),
    ("Not released under the MIT license", ["MIT"]),
])
def test_license_text(text, want):
    _, found = licenses.scan_text(text, licenses.prepare())
    assert sorted(x["license"] for x in found) == want


def test_license_differences():
    _, found = licenses.scan_text("Permission is hereby granted, free of charge, to any person who is obtaining a copy of "
                                  "this software and associated documentation files (the \"Software\"), to deal in "
                                  "the Software without restriction", licenses.prepare())
    assert [(x["license"], x["lacks"], x["adds"]) for x in found] == [("MIT", [], ["who", "is"])]


MIT_NOTICE = "Released under the MIT License."


@pytest.mark.parametrize("text,want", [
    ("This tool was written over several long winters by a small group of friends who wanted a better way to sort "
     "their photographs and share them with family members living far away. " + MIT_NOTICE, ["MIT"]),
    ("".join(f"Copyright {2001 + i} Author{i}\n" for i in range(5)) + MIT_NOTICE, ["MIT"]),
    (prose(3000, "line") + " Licensed under CC BY 4.0. " + prose(3000, "more"), ["CC-BY-4.0"]),
    (prose(200, "gpl").replace("\n", " ") + " This work is licensed under the GNU General Public License, version 3.",
     ["GPL-3.0"]),
    ("\n".join(t.rstrip(".") for _, t in licenses.TEMPLATES), sorted(n for n, _ in licenses.TEMPLATES)),
    (" ".join([MIT_NOTICE] * 3), ["MIT"] * 3),
    ("word " * 300 + "Licensed under the Apache License, Version 1.1.", []),
])
def test_license_in_a_large_block(text, want):
    """A notice is found whatever else its block holds, at every place."""
    _, found = licenses.scan_text(text, licenses.prepare())
    assert sorted(x["license"] for x in found) == want


def test_license_changes_up_to_the_limit():
    """Every notice with as many lacking and added words as may be is found inside a large block."""
    r, prepared = random.Random(1), licenses.prepare()
    for made in [x for x in prepared[0] if x.changes] * 40:
        free = [i for i, w in enumerate(made.words) if not licenses.fixed(w)]
        lost = set(r.sample(free, r.randint(0, made.changes)))
        more = set(r.sample(range(1, len(made.words) - 1), r.randint(0, made.changes)))
        words = [x for i, w in enumerate(made.words) for x in [w] * (i not in lost) + ["zz"] * (i in more)]
        text = "license " + "pp " * r.randint(0, 60) + " ".join(words) + " qq" * r.randint(0, 60)
        assert made.name in {x["license"] for x in licenses.scan_text(text, prepared)[1]}, text


def test_licenses_table(spark, docs, rows, empty):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    got = {r.doc_id: r.licenses for r in queries.op7_licenses(spark, "/root/testdata/sf0.01").collect()}
    for r in table(spark, "/root/testdata/sf0.01", "documents").collect():
        assert got[r.doc_id] == ",".join(sorted({v for k, v in lines.items() if k in (r.text or "").split("\n")}))
    assert bag(licenses.scan(docs), "doc_id") == Counter((d,) for d, _ in rows)
    assert licenses.scan(empty).count() == 0


# -- 8 ----------------------------------------------------------------------------------------

def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex(), "component_id")
    assert bag(got) == Counter(brute.simhash(rows))
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert bag(queries.op8_simhash(spark, sf)) == Counter(brute.simhash(rows))


def test_bit_slices():
    r = np.random.default_rng(1)
    a = r.integers(0, 2 ** 64, 150, dtype=np.uint64)
    b = np.concatenate([a[:70] ^ np.uint64(0b1011), a[:30] ^ np.uint64(0b11111), ~a[:5], r.integers(0, 2 ** 64, 40, dtype=np.uint64)])
    near = simhash.within(a, simhash._planes(b), 4)
    bits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :len(b)]
    assert np.array_equal(bits.astype(bool), np.bitwise_count(a[:, None] ^ b[None, :]) <= 4)
    for radius in (0, 1, 3, 9):
        near = np.unpackbits(simhash.within(a, simhash._planes(b), radius).view(np.uint8), axis=1, bitorder="little")
        assert np.array_equal(near[:, :len(b)].astype(bool), np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


@pytest.fixture(scope="module")
def clusters():
    """Fingerprints around twelve centres and (fingerprint, root) of those that link within 4 bits."""
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << r.randrange(20) for _ in range(r.randint(0, 5))) for b in base for _ in range(60)}
    fps |= {b ^ sum(1 << i for i in r.sample(range(64), 4)) for b in base for _ in range(20)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    u = np.array(fps, np.int64).view(np.uint64)
    pairs = np.argwhere(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4).tolist()
    root = brute.reachable(len(fps), [(a, b) for a, b in pairs if a != b])
    return fps, Counter((fps[i], fps[root[i]]) for i in {a for a, b in pairs if a != b})


def test_simhash_cells_that_are_split(spark, monkeypatch, clusters):
    monkeypatch.setattr(simhash, "CELL", 16)
    fps, want = clusters
    assert bag(components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long").repartition(5), 4))) == want


@pytest.mark.parametrize("blocks", [5, 6, 8, 10])
def test_simhash_any_cut_finds_all(spark, monkeypatch, clusters, blocks):
    monkeypatch.setattr(simhash, "cut_for", lambda n, radius: blocks)
    fps, want = clusters
    assert bag(components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4))) == want


def test_simhash_copies_do_not_follow_the_table(spark, monkeypatch):
    """With cells of 4, 5 blocks mean more copies of a row the more rows there are; the chosen cut does not."""
    monkeypatch.setattr(simhash, "CELL", 4)
    chosen = [simhash.cut_for(n, 4) for n in (1000, 10 ** 6, 10 ** 8, 10 ** 10)]
    assert chosen[0] == 5 and chosen == sorted(chosen)
    assert simhash.copies(10 ** 10, 5, 4) > 10 ** 6 and simhash.copies(10 ** 10, chosen[-1], 4) <= 126
    monkeypatch.setattr(simhash, "CELL", 2048)
    assert simhash.cut_for(10 ** 10, 4) == 7 and simhash.copies(10 ** 10, 7, 4) <= 40
    r = np.random.default_rng(3)
    monkeypatch.setattr(simhash, "CELL", 1)
    rows = []
    for n in (20_000, 80_000):
        fps = spark.createDataFrame(pd.DataFrame({"fp": r.integers(-2 ** 63, 2 ** 63, n, dtype=np.int64)})).cache()
        rows.append(simhash._cells(fps, 4, simhash.cut_for(n, 4)).count() / n)
    assert rows[1] <= 1.2 * rows[0] + 1  # dealt alone would be four times


def test_join_back_is_split(spark):
    """A key that holds nearly all rows is many tasks of the join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(200_000, numPartitions=16).selectExpr("if(id % 100 = 0, id, 7) AS k", "id AS v")
        joined = join_back(rows, rows.groupBy("k").agg(F.min("v").alias("m")), "k")
        got = joined.agg(F.count("*"), F.sum("m"), F.sum("k"))
        assert got.collect()[0][0] == 200_000 and joined.columns == ["k", "v", "m"]
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# -- 9 ----------------------------------------------------------------------------------------

def ordered(rows):
    """Equal ids follow by text hash in the operator; the fixture's brute order is by text."""
    return [r for r in rows if r[0] != 8 and r[0] is not None]


def test_substring(spark, docs, rows, empty):
    part = ordered(rows)
    df = docs.where("doc_id is not null and doc_id <> 8")
    got = substring.remove_repeats(df).select(substring.restore_id("doc_id"), "n_words", "n_removed", F.sha2("text", 256))
    assert bag(got) == Counter(brute.substring(part))
    all_rows = substring.remove_repeats(docs).select(substring.restore_id("doc_id"), "n_words")
    assert bag(all_rows) == Counter((d, len(brute.words(t))) for d, t in rows)
    assert substring.remove_repeats(empty).count() == 0


def test_substring_null_id_is_first(spark):
    df = spark.createDataFrame([(None, PASSAGE), (1, PASSAGE), (1, PASSAGE)], "doc_id long, text string")
    got = substring.remove_repeats(df).select(substring.restore_id("doc_id"), "n_words", "n_removed")
    assert bag(got) == Counter({(None, 45, 0): 1, (1, 45, 45): 2})


@pytest.mark.parametrize("parts", [1, 3])
def test_substring_texts_of_one_id_with_equal_short_hash(spark, parts):
    """Two texts under the null id whose xxhash64 agrees in its low 32 bits are two documents."""
    one, two = (" ".join(f"w{j}x{i}" for j in range(25)) for i in (441, 96761))
    rows = [(None, one), (None, two), (7, two), (8, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.where("doc_id is null").agg(F.count_distinct(F.expr("xxhash64(text) & 4294967295"))).first()[0] == 1
    got = substring.remove_repeats(df.repartition(parts)).select("id", "n_words", "n_removed", F.sha2("text", 256))
    assert bag(got.withColumn("id", substring.restore_id("id"))) == Counter(brute.substring(rows))


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_substring_in_small_batches(spark, batch):
    r = random.Random(8)
    parts = [prose(r.randint(5, 60), f"p{i}") for i in range(12)]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 6)))) for i in range(60)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        for piece in (3, substring.PIECE):
            got = substring.remove_repeats(df, piece=piece).select("id", "n_words", "n_removed", F.sha2("text", 256))
            assert bag(got) == Counter(brute.substring(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_substring_hot_phrase_that_branches(spark):
    """A phrase of many documents with other words around it: a batch sends two rows of its anchor, whatever the
    number of documents; rows that repeat a document are one."""
    phrase = prose(24, "phrase")
    made = [(i, prose(30, f"b{i}") + " " + phrase + " " + prose(30, f"a{i}")) for i in range(120)]
    rows = made + [made[7]] * 40 + [(200, made[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sent = substring._runs(substring._keyed(df, "doc_id", "text"), 20, 8)
    hot = sent.where(F.col("kind").isin(substring.ALONE, substring.MARK)).groupBy("anchor").count()
    assert hot.agg(F.max("count")).first()[0] <= 2
    for parts in (1, 7):
        out = substring.remove_repeats(df.repartition(parts)).select("id", "n_words", "n_removed", F.sha2("text", 256))
        assert bag(out) == Counter(brute.substring(rows))


def test_substring_paths(spark):
    """Edges that follow one another in both documents are one path, cut at the multiples of a piece; another lead or
    another distance begins a new path; a repeated edge counts once."""
    edges = [(9, 0, 0, 10, 4, 1, 0, 0, 100), (9, 0, 0, 14, 6, 1, 0, 0, 104), (9, 0, 0, 14, 6, 1, 0, 0, 104),
             (9, 0, 0, 20, 2, 1, 0, 0, 300), (9, 0, 0, 22, 1, 2, 0, 0, 302), (9, 0, 0, 30, 1, 1, 0, 0, 120),
             (9, 0, 0, 50, 5, None, None, None, None)]
    df = spark.createDataFrame(edges, "id long, th long, tk long, start long, size int, lid long, lth long, ltk long, lstart long")
    names = ["start", "size", "lid", "lstart"]
    rest = {(20, 2, 1, 300), (22, 1, 2, 302), (30, 1, 1, 120)}
    assert bag(substring._paths(df).select(names)) == Counter({(10, 10, 1, 100), *rest})
    cut = {(10, 4, 1, 100), (14, 6, 1, 104)}
    assert bag(substring._paths(df, 8).select(names)) == Counter({*cut, *rest})


def test_substring_verifies_words(spark):
    """Spans whose hashes agree by chance are kept: their words are compared."""
    import numpy as np
    import pyarrow as pa
    from deadwire.llm.words import split_words
    same, other = (" ".join(prose(30, x).split()) for x in ("same", "other"))
    words = split_words(pa.array([same, same.replace(" ", "\n "), other]))
    first, size = words.first[:3], np.full(3, 11)
    for lead, agree in (([0, 0, 0], [False, True, False]), ([0, 1, 2], [False] * 3)):
        found = substring._agreeing(words, first, size, np.array(lead), np.arange(3), 20)
        assert found.tolist() == agree
    told = np.array([substring.hashlib.sha256(same.encode()).digest()] * 2 + [None], object)
    where = np.array([1, 2, 2]), np.array([0, 0, 0]), np.array([11, 11, 1])
    gone = substring._removed(words, *where, told, 20)
    assert [int(gone[words.doc_of() == d].sum()) for d in range(3)] == [0, 30, 20]


def test_substring_layout(spark):
    rows = [(1, "Start.\n" + PASSAGE), (2, "  keep this \n" + PASSAGE + "\n\tand that ")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    out = {r.id: (r.text, r.lang) for r in substring.remove_repeats(df, layout=True, carry=("lang",)).collect()}
    assert out == {1: (rows[0][1], "en"), 2: ("  keep this \nand that ", "en")}


def test_substring_table(spark, whole):
    assert bag(queries.op9_substring(spark, SF)) == Counter(brute.substring(whole))


# -- 10 ---------------------------------------------------------------------------------------

CASES = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>x"), (1, 1, "assistant", "<|im_end|>"),
         (2, None, None, None), (2, 5, "a\\n\nb", "<\\|x|> <\\\\| <"), (None, 1, "assistant", ""), (None, 0, "user", "é😀"),
         (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (4, 0, "<|im_start|>", "\\"), (5, 0, "assistant", "y" * 9000)]


def test_chat_rows(spark):
    df = spark.createDataFrame(CASES, "conv_id long, turn long, role string, text string").repartition(3)
    records = df.select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record"), F.lit("z").alias("segment"))
    made = chat.format_chat(chat.canonical_turns(records.drop("segment"), mappings=(
        chat.Mapping("turn row", role="role", text="text", optional=("role", "text")),)))
    # a row without role and text has no paths; it is the variant without both
    got = {tuple(r) for r in chat.read_digests(made, "conv_id", ["turn", "seq", "segment"]).collect()}
    assert got == brute.chat(CASES)
    assert chat.read_digests(made.limit(0), "conv_id", ["turn"]).count() == 0


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, SF, "conversations").collect()]
    rows += [(-1, 0, "user", queries.CONTROL), (-1, 1, "assistant", queries.CONTROL)]
    assert {tuple(r) for r in queries.op10_chat(spark, SF).collect()} == brute.chat(rows)


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|im_end|>", "<|<|<\\||", "plain", "<|im_end|>\n", "\\<|\\"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    segment, a, b = chat.format_turn(text, text, True)
    assert chat.parse_turn(segment) == (text, text) and chat.unescape(segment[a:b]) == text


@pytest.mark.parametrize("record,layout,want", [
    ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', "messages",
     [("user", "q"), ("assistant", "a")]),
    ('{"messages":[{"content":"q","role":"user"},{"role":"assistant","content":null}],"id":3}', "messages",
     [("user", "q"), ("assistant", "")]),
    ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"system":"s"}', "sharegpt",
     [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ('{"instruction":"i","input":"x","output":"o"}', "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ('{"output":"o","instruction":"i","input":""}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"prompt":"p","completion":"c"}', "prompt", [("user", "p"), ("assistant", "c")]),
    ('{"question":"q","context":"k","answer":"a"}', "question", [("user", "q\n\nk"), ("assistant", "a")]),
    ('{"other":{"deep":[1]}}', None, [(None, None)]), ("no json", None, [(None, None)]), (None, None, [(None, None)]),
    ("[1]", None, [(None, None)]),
])
def test_layouts(spark, record, layout, want):
    got = chat.canonical_turns(spark.createDataFrame([(1, record)], "n long, record string")).orderBy("seq").collect()
    assert [(r.role, r.turn_text) for r in got] == want and {r.layout for r in got} == {layout}


def test_fingerprints_do_not_clash():
    seen = {}
    for m in chat.MAPPINGS:
        for f in set(m.fingerprints()):
            assert seen.setdefault(f, m.name) == m.name
