"""The pipeline and the queries' SQL against brute force on sf0.001."""
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import brute
import corpus_pipeline
from deadwire.llm.common import table
from deadwire.llm import oracle, packing, tokens

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "conversations"]


def cut(text, gone):
    """The text without its words ``gone``, each with the white space after it."""
    spans = [m.span() for m in brute.WORD.finditer(text)]
    out, at = text[:spans[0][0]] if spans else text, 0
    for i, (a, b) in enumerate(spans):
        end = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        if i not in gone:
            out += text[a:end]
    return out


def brute_run(docs):
    docs = [d for d in docs if brute.quality(d[1])["kept"]]
    docs = [d for d, (i, _, c) in zip(docs, brute.simhash(docs)) if i == c]
    first = {}
    for d, t in sorted(docs):
        ws = brute.words(t)
        for i in range(len(ws) - 19):
            first.setdefault(tuple(ws[i:i + 20]), (d, i))
    clean = []
    for d, t in docs:
        ws = brute.words(t)
        gone = {j for i in range(len(ws) - 19) if first[tuple(ws[i:i + 20])] != (d, i) for j in range(i, i + 20)}
        clean.append((d, cut(t, gone)))
    tok = tokens.load_library(tokens.public_path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in clean:
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 0], 0
        for size in packing.lengths(len(ids)):
            want[(d, at, size, len(ids), brute.crc(ids[at:at + size]))] += 1
            at += size
    return want


def test_pipeline(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = corpus_pipeline.run(spark, SF)
    import zlib
    rows = got.collect()
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, zlib.crc32(bytes(r.ids))) for r in rows) == brute_run(docs)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))


def test_stages_on_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, long, "en", "s", 1), (None, None, None, None, None),
            (3, "", "en", "s", 0), (None, long + " x", "en", "s", 1), (4, long[:400] + " " + " ".join(
                f"v{i}" for i in range(300)), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        if k < 3:
            assert out.columns == corpus_pipeline.COLUMNS
        n = out.count()
    deduped = corpus_pipeline.simhash_dedup(spark, docs, SF)
    assert Counter(r.doc_id for r in deduped.collect())[1] == 1


def test_near_dedup_of_null_and_repeated_ids(spark):
    """One row stays of each group, whatever ids its rows have; two texts of one id are two groups."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(200)) for x in "abcd")
    texts = [(None, a), (4, a), (3, a), (None, a), *[(None, b)] * 30, (None, b), (7, c), (7, d), (7, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.simhash_dedup(spark, docs, SF)
    assert out.columns == corpus_pipeline.COLUMNS
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(3, a), (None, b), (7, c), (7, d)])


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({E.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_all_are_registered():
    known = E.queries()
    assert [sum(k.startswith(f"op{n}_") for k in known) for n in range(1, 11)] == [1] * 10 and "pipeline" in known
