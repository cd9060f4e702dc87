"""Points in ranges (J7), global ranks (O-1) and the accounting of bad documents."""
import json
import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from deadwire.operators.order import global_rank
from deadwire.operators.ranges import contained
from deadwire.sources.derived import ROWS_PER_TASK, dealt, derived_files
from deadwire.sources.files import accounting, parse_expected, parse_precomputed, read_expected, read_precomputed_fields
from deadwire.sources.forms import form_files


def test_points_in_nested_and_overlapping_ranges(spark):
    rng = random.Random(8)
    points = [(rng.choice("abc"), rng.choice([rng.randint(-50, 400), rng.randint(0, 10**6)])) for _ in range(600)]
    points += [("a", None), (None, 5), ("hot", 7), ("hot", 7)]
    ranges = []
    for _ in range(60):
        start = rng.randint(-60, 300)
        ranges.append((rng.choice("abd"), start, start + rng.choice([0, 1, 2, 15, 16, 17, 200, -3])))
    ranges += [("c", 0, 900_000), ("c", 0, 900_000), ("c", 10, 20), ("hot", 7, 8), ("a", None, 4), (None, 0, 10)]
    p = spark.createDataFrame(points, "k string, at int")
    r = spark.createDataFrame(ranges, "k string, start long, end long")
    got = sorted(map(tuple, contained(p, r, ["k"]).collect()))
    want = sorted((k, at) for k, at in points if k is not None and at is not None and any(
        k == q and s is not None and s <= at < e for q, s, e in ranges))
    assert got == want and ("hot", 7) in got
    assert contained(p, r.where("false"), ["k"]).count() == 0 and contained(p.where("false"), r, ["k"]).count() == 0


def test_rank_over_range_partitions(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("aAbB-_/:1") for _ in range(rng.randint(0, 4))) for _ in range(700)] + [None, None]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int").repartition(7)
    by = [F.collate(F.col("name"), "UNICODE"), F.col("i")]
    kept = lambda d, name: d.cache()
    got = [r.i for r in global_rank(df, by, kept).orderBy("rank").collect()]
    assert got == [r.i for r in df.orderBy(*by).collect()]
    assert sorted(r.rank for r in global_rank(df, by, kept).collect()) == list(range(1, 703))
    assert global_rank(df.where("false"), by, kept).count() == 0


def test_bad_documents_are_counted(spark):
    docs = [("r", "1", json.dumps({"endpoint": "GET /a", "deadFields": ["x", "y"]})), ("r", "2", '{"endpoint": "GET /b", "deadF'),
            ("r", "3", ""), ("r", "4", None), ("r", "5", '{"endpoint": "e", "deadFields": 3}'), ("r", "6", '{"deadFields": []}'),
            ("r", "7", "[1, 2]"), ("s", "1", '{"endpoint": "e", "deadFields": [], "more": {"a": 1}}'), ("s", "2", "nonsense")]
    parsed = parse_expected(spark.createDataFrame(docs, "repo string, path string, content string"))
    assert {(r.repo, r.path) for r in parsed.where("not bad").collect()} == {("r", "1"), ("s", "1")}
    assert all(r.endpoint is None and r.dead_fields is None for r in parsed.where("bad").collect())
    seen = Observation("truth")
    assert {tuple(r) for r in accounting(parsed, seen).collect()} == {("r", 1, 6), ("s", 1, 1)}
    assert seen.get == {"n_parsed": 2, "n_bad": 7}


def test_precomputed_facts_of_any_shape(spark):
    field = {"name": "a", "side": "response", "definedAt": "c:/x.ts:12", "wasteScore": 1}
    docs = [("r", "1", json.dumps({"defined": [field], "accessed": []})), ("r", "2", json.dumps({"accessed": [field, {"name": "b"}]})),
            ("r", "3", "{}"), ("r", "4", json.dumps({"defined": "x"})), ("r", "5", json.dumps({"defined": []}))]
    parsed = parse_precomputed(spark.createDataFrame(docs, "repo string, path string, content string"))
    facts = {(r.path, *r.f) for r in parsed.select("path", F.explode("facts").alias("f")).collect()}
    assert facts == {("1", "def", "a", "response", "c:/x.ts", 12), ("2", "read", "a", "response", "c:/x.ts", 12),
                     ("2", "read", "b", None, None, None)}
    assert {tuple(r) for r in accounting(parsed).collect()} == {("r", 3, 2)}


def test_files_with_a_broken_one_among_them(spark, tmp_path):
    for name, truth, fields in (("p1", {"endpoint": "e", "deadFields": ["x"]}, {"defined": [], "accessed": []}), ("p2", None, None)):
        d = tmp_path / name
        d.mkdir()
        (d / "expected.json").write_text(json.dumps(truth, indent=2) if truth else '{"endpoint": "e",\n "dead')
        (d / "fields.json").write_text(json.dumps(fields, indent=2) if fields else "")
    assert [tuple(r) for r in read_expected(spark, str(tmp_path / "*" / "expected.json")).collect()] == [("p1", "e", ["x"])]
    assert read_precomputed_fields(spark, str(tmp_path / "*" / "fields.json")).count() == 0


def test_report_documents_in_chunks_and_order(spark, tmp_path):
    import glob
    from deadwire.plans.pipeline import Analysis
    from deadwire.sources.report import read_documents, write_documents
    keys = "".join(f"        'key{i:02}': 1,\n" for i in range(23))
    back = "from flask import jsonify\n@app.route('/api/b-x')\ndef f():\n    return jsonify({\n" + keys + "    })\n"
    routes = "app.get('/api/B', h)\napp.get('/api/a_y', h)\n"
    front = "fetch('/api/b-x').then(r => r.key03)\n"
    files = spark.createDataFrame([(r, p, lang, c) for r in ("one", "two") for p, lang, c in (
        ("api.py", "py", back), ("routes.ts", "ts", routes), ("web.ts", "ts", front))], "repo string, path string, lang string, content string")
    a = Analysis.of(spark, files)
    out = str(tmp_path / "report")
    write_documents(a, out, chunk=5)
    got = read_documents(spark, out)
    assert [r.name for r in got.where("repo = 'one' and section = 'endpoints'").orderBy("place").collect()] == [
        "GET /api/a_y", "GET /api/B", "GET /api/b-x"]
    dead = got.where("repo = 'two' and section = 'deadFieldAnalysis'").orderBy("place").collect()
    assert [(r.place, r.chunk, r.name) for r in dead] == [
        (i + 1, i // 5, n) for i, n in enumerate(f"key{i:02}" for i in range(23) if i != 3)]
    lines = [json.loads(x) for f in sorted(glob.glob(f"{out}/part-*")) for x in open(f)]
    assert [(x["repo"], x["section"], x["chunk"]) for x in lines] == [
        (r, s, c) for r in ("one", "two") for s, n in (("deadFieldAnalysis", 5), ("endpoints", 1), ("globalDeadFieldAnalysis", 5))
        for c in range(n)]
    assert max(len(x["items"]) for x in lines) == 5
    a.close()


def test_corpus_rows_are_dealt_to_tasks_by_their_number(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    part = spark.range(4000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 3).alias("p_brand"),
                                    (F.col("id") % 50).cast("int").alias("p_size"))
    part.union(part.where("p_partkey < 3")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.createDataFrame([(5, "R", 1), (5, "R", 1), (7, "A", 1), (None, "R", 1)], "l_partkey long, l_returnflag string, l_linenumber int")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for corpus, n in ((form_files, 4003), (derived_files, None)):
        files = corpus(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
        per_task = [r["count"] for r in files.groupBy("task").count().collect()]
        assert len(per_task) >= min(cores, 4) // 2 + (cores > 1) and (n is None or sum(per_task) == n)
    want = derived_files(spark, str(tmp_path), deal=False)
    assert files.drop("task").exceptAll(want).count() == 0 and files.count() == want.count()
    # a task's rows do not follow the table
    tasks = [dealt(spark.range(9), n).rdd.getNumPartitions() for n in (0, 1, 4 * cores * ROWS_PER_TASK, 40 * cores * ROWS_PER_TASK)]
    assert tasks == [1, 1, 4 * cores, 40 * cores]
