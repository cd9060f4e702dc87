"""Merkle manifest, prefix trie and nearest-neighbour search against brute force: awkward small tables, random ones
with shrunken blocks, and the driver's sf0.001 tables whole."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from deadwire.llm import hashing, merkle, queries, trie
from deadwire.llm.common import table

SF = "/root/testdata/sf0.001"
CLASH = ["grp", "pos", "n", "node", "up", "m", "row", "levels", "root", "steps", "block", "name"]


# -- Merkle manifest ---------------------------------------------------------------------------

def proofs(spark, rows):
    names = ", ".join(f"`{c}` string" for c in CLASH)
    df = spark.createDataFrame([(g, o, hashlib.sha256(x.encode()).hexdigest(), *CLASH) for g, o, x in rows],
                               f"source string, doc_id long, leaf string, {names}").repartition(3)
    out = merkle.manifest(df, "source", "doc_id")
    return sorted((r.source or "", r.doc_id or -1, r.leaf, r.subroot, r.root,
                   [(s.left.decode(), s.right.decode()) for s in r.steps]) for r in out.collect())


def expected(rows):
    rows = [(g, o, hashlib.sha256(x.encode()).hexdigest()) for g, o, x in rows]
    return sorted((g or "", o or -1, leaf, *made) for (g, o, leaf), made in zip(rows, brute.merkle(rows)))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 3, 4], [9, 10, 1, 27], [243, 244], [730, 5, 1, 1, 1]])
def test_merkle_trees_of_any_size(spark, sizes):
    rows = [(f"s{g}", i * 3, f"{g}/{i}") for g, n in enumerate(sizes) for i in range(n)]
    assert proofs(spark, rows) == expected(rows)


def test_merkle_nulls_ties_repeats_and_many_sources(spark):
    rows = [(None, 1, "a"), ("", 1, "b"), (None, None, "c"), ("é", 2, "d"), ("z", 2, "e"), ("Z", 2, "f"),
            ("z", 2, "g"), ("z", 2, "e"), ("z", None, "h"), ("z", None, "h")]
    rows += [(f"many{i % 300}", i, str(i)) for i in range(301)]
    assert proofs(spark, rows) == expected(rows)


def test_merkle_fold_finds_any_change(spark):
    rows = [("a", i, f"a{i}") for i in range(20)] + [("b", i, f"b{i}") for i in range(4)]
    df = spark.createDataFrame([(g, o, hashlib.sha256(x.encode()).hexdigest()) for g, o, x in rows],
                               "source string, doc_id long, leaf string")
    out = merkle.manifest(df, "source", "doc_id").select(
        "root", merkle.fold(F.col("leaf"), F.col("steps")).alias("same"),
        merkle.fold(F.sha2("leaf", 256), F.col("steps")).alias("other")).collect()
    assert len(out) == 24 and all(r.same == r.root != r.other for r in out)


def test_merkle_query_on_awkward_documents(spark, tmp_path):
    docs = [(1, "a\nb", "en", "s", 3), (2, None, None, "s", None), (3, "", "en", None, 0), (None, "x\ny", "en", "s", 3),
            (4, "a\nb", "en", "s", 3), (4, "a\nb", "en", "s", 3), (5, "\n" * 5, "de", "", 5), (6, "L" * 200_000 + "\n", "de", "t", 1),
            (7, "😀\n", None, "t", 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.leaf, r.root, r.verified, r.folded_root == r.root) for r in queries.op12_merkle(spark, str(tmp_path)).collect()}
    leaf = {}
    for i, text, lang, source, n in docs:
        leaf[i, source] = brute.sha("".join(map(brute.hashed, (i, source, lang, n, text))))
    root = brute.merkle([(s, i, leaf[i, s]) for i, _, _, s, _ in docs])[0][1]
    changed = {i for i, t, *_ in docs if i is not None and "\n" in (t or "") and brute.zlib.crc32(str(i).encode()) % 2 == 0}
    assert got == {(i, x, root, i not in changed, i not in changed) for (i, _), x in leaf.items()}
    assert changed and changed != {i for i, t, *_ in docs if "\n" in (t or "")}


def test_merkle_empty(spark):
    empty = spark.createDataFrame([], "source string, doc_id long, leaf string")
    assert merkle.manifest(empty, "source", "doc_id").collect() == []


# -- prefix trie -----------------------------------------------------------------------------------

TURNS = "conv_id long, turns array<struct<digest: string, size: bigint>>"


def digest(turn):
    return brute.sha(str(turn))[:32]


def built(spark, convs, **limits):
    df = spark.createDataFrame([(i, None if c is None else [(digest(t), s) for t, s in c], "x", "y") for i, c in convs],
                               TURNS + ", depth string, low string").repartition(5)
    return sorted(map(tuple, trie.trie(df, **limits).collect()), key=repr)


@pytest.mark.parametrize("rows,fan,n,alphabet", [(3, 2, 120, 2), (1, 3, 60, 2), (5, 2, 250, 3), (7, 64, 150, 1), (1 << 15, 64, 300, 2)])
def test_trie_of_random_conversations(spark, rows, fan, n, alphabet):
    r = random.Random(n)
    convs = []
    for _ in range(n):
        turns = [(t, 7 + t) for t in (r.randrange(alphabet) for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9, 20])))]
        convs += [(len(convs) + k - 20, turns) for k in range(r.choice([1, 1, 4, 9]))]
    r.shuffle(convs)
    assert built(spark, convs, chunk_rows=rows, fan=fan) == sorted(brute.trie(convs), key=repr)


def test_trie_edge_cases(spark):
    long = [(i % 7, 3) for i in range(300)]
    convs = [(1, None), (2, []), (3, long), (4, long[:299]), (4, long[:299]), (-9, [(8, 0)])]
    assert built(spark, [*convs, (None, long)], chunk_rows=2) == sorted(brute.trie([(i, c or []) for i, c in convs]), key=repr)
    assert built(spark, [(5, [(1, 1)])]) == sorted(brute.trie([(5, [(1, 1)])]), key=repr)
    assert trie.trie(spark.createDataFrame([], TURNS)).collect() == []


def test_trie_ids_of_many_copies_are_one_list(spark):
    convs = [(i, [(1, 2), (2, 3)]) for i in range(5000)] + [(5000, [(1, 2)])]
    assert built(spark, convs, chunk_rows=900, fan=2) == sorted(brute.trie(convs), key=repr)


def test_trie_chunks_are_bounded_by_bytes_too(spark):
    convs = [(i, [(0, 1)] * 40 + [(i % 11, 1)]) for i in range(200)]
    assert built(spark, convs, chunk_bytes=5000, fan=3) == sorted(brute.trie(convs), key=repr)


def test_trie_query(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c % 3} {t}") for c in range(-7, 60) for t in range(c % 6 + 1)]
    rows += [(61, None, None, None), (61, 0, "user", "é"), (61, 0, "user", "a"), (61, 0, "user", "a"), (None, 1, "user", "lost")]
    schema = "conv_id long, turn int, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder, given in ((str(tmp_path), rows), (SF, [tuple(r) for r in table(spark, SF, "conversations").select(
            "conv_id", "turn", "role", "text").collect()])):
        got = sorted(map(tuple, queries.op11_prefix_trie(spark, folder).collect()), key=repr)
        assert got == sorted(brute.trie(brute.rebuilt(given)), key=repr)


# -- nearest neighbours ----------------------------------------------------------------------------

def answers(spark, rows, asked=lambda c: c % 20 == 0, **more):
    df = spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in rows],
                               "vec_id long, embedding array<float>, score string, h1 int, rank int, ids string").repartition(3)
    return hashing.nearest(df, asked(F.col("vec_id")), **more).collect()


def recall(got, true):
    found, of = {}, 0
    for r in got:
        found.setdefault(r.query_id, set()).add(r.id)
    hit = 0
    for (i, _), best in true.items():
        of += len(best)
        hit += len(found.get(i, set()) & {j for _, j in best})
    return hit / of


def float32(rng, n, dim, scale=None):
    x = rng.standard_normal((n, dim)).astype(np.float32)
    return x if scale is None else x * scale[:, None].astype(np.float32)


@pytest.mark.parametrize("kind", ["clusters", "norms", "random", "near copies"])
def test_search_recall_order_and_scores(spark, kind):
    rng = np.random.default_rng(3)
    x = float32(rng, 1500, 24)
    if kind == "clusters":
        x = x * 0.3 + float32(rng, 12, 24)[rng.integers(0, 12, 1500)]
    if kind == "norms":
        x = float32(rng, 1500, 24, np.exp(rng.standard_normal(1500)))
    if kind == "near copies":
        x[:700] = x[0] + 0.001 * x[:700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, true = answers(spark, rows, shard_rows=200), brute.nearest(rows, lambda i: i % 20 == 0)
    assert recall(got, true) >= 0.9
    lists = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert r.score == pytest.approx(float(np.dot(x[r.query_id].astype(float), x[r.id].astype(float))), rel=1e-12)
        lists.setdefault(r.query_id, []).append((-r.score, r.id, r.rank))
    assert len(lists) == 75
    for found in lists.values():
        assert [r for *_, r in found] == list(range(1, 21)) and [f[:2] for f in found] == sorted(f[:2] for f in found)


def test_search_ties_copies_and_few_rows_are_exact(spark):
    one, two = [1.0, 0.0, 2.0], [0.0, 3.0, 0.0]
    rows = [(i, one) for i in range(60)] + [(i, two) for i in range(60, 75)] + [(20, one), (80, two), (80, one)]
    rows += [(100, None), (101, []), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 1.0]), (160, [1.0, float("nan"), 0.0]),
             (180, [float("inf"), 0.0, 0.0]), (None, one), (200, [1.0, 2.0]), (201, [-0.0, 1.0]), (220, [5.0])]
    true = brute.nearest(rows, lambda i: i % 20 == 0)
    got = {}
    for r in sorted(answers(spark, rows), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.score, r.id))
    want = {i: best for (i, _), best in true.items() if i != 80}
    got_80 = sorted(got.pop(80))
    assert got_80 == sorted(x for (i, _), best in true.items() if i == 80 for x in best)
    assert got == {i: best for i, best in want.items() if best}


def test_search_without_rows_or_queries(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(20, None)], [(20, [1.0])]):
        df = spark.createDataFrame(rows, schema)
        assert hashing.nearest(df, F.col("vec_id") % 20 == 0).collect() == []


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (900, 4)).astype(np.uint16)
    codes[:400] = codes[0] ^ (1 << rng.integers(0, 16, (400, 4))).astype(np.uint16) * (rng.random((400, 4)) < 0.5).astype(np.uint16)
    shard = hashing.Shard(codes)
    for code in codes[::90]:
        far = np.array([sum(int(a ^ b).bit_count() for a, b in zip(c, code)) for c in codes])
        for radius in (0, 1, 2, 3, 5, 8, 13, 20, 31, 40, 64, None):
            want = np.arange(900) if radius is None else np.flatnonzero(far <= radius)
            assert np.array_equal(shard.within(code, radius), want)


def test_search_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    got = queries.op13_nearest(spark, SF).withColumnRenamed("vec_id", "id").collect()
    true = brute.nearest(rows, lambda i: i % 20 == 0)
    assert recall(got, true) >= 0.9 and len(got) == sum(len(b) for b in true.values())
