"""Findings kept up to date by repo (T1) and withdrawn on edit."""
import os
import random
import tempfile

import pytest

from deadwire.plans.pipeline import Analysis
from deadwire.streaming import maintain, rescan, validity
from deadwire.streaming.rescan import LANDING_SCHEMA, write_drop

FRONT = "export async function f() {\n  const r = await fetch('/api/items');\n  const b = await r.json();\n  return [%s];\n}\n"
BACK = "from flask import jsonify\n@app.route('/api/items')\ndef items():\n    return jsonify({'itemName': 1, 'itemPrice': 2})\n"


def files(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


@pytest.fixture()
def folders():
    base = tempfile.mkdtemp(prefix="deadwire-maintain-test-")
    return [os.path.join(base, x) for x in ("landing", "state", "ckpt")]


def dead(spark, state):
    return sorted((r.repo, r.source, r.path, r.name) for r in maintain.view(spark, state, "findings").collect())


def both(repo, *names):
    return [(repo, s, "api/app.py", n) for n in names for s in ("endpoint", "global")]


def listing(state, batch):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(state) for f in fs if f"batch={batch}" in d}


def test_a_save_rewrites_its_repo_only(spark, folders):
    landing, state, ckpt = folders
    reads = FRONT % "b.itemName, b.itemPrice"
    write_drop(files(spark, [(r, p, c) for r in ("shop", "bank") for p, c in (("web/f.ts", reads), ("api/app.py", BACK))]), landing, 1)
    maintain.run_maintained(spark, landing, state, ckpt)
    assert dead(spark, state) == []
    first = listing(state, 0)
    write_drop(files(spark, [("shop", "web/f.ts", FRONT % "b.itemName")]), landing, 2)
    maintain.run_maintained(spark, landing, state, ckpt)
    assert dead(spark, state) == sorted(both("shop", "itemPrice"))
    assert listing(state, 0) == first
    assert {(r.batch, r.repo, r.n_files) for r in maintain.rewritten(spark, state).collect()} == {
        (0, "shop", 2), (0, "bank", 2), (1, "shop", 1)}
    # older, repeated and unknown files touch nothing; a deletion takes its findings away
    write_drop(files(spark, [("shop", "web/f.ts", reads), ("bank", "README.md", "x")]), landing, 1)
    write_drop(files(spark, [("shop", "web/f.ts", FRONT % "b.itemName")]), landing, 2)
    maintain.run_maintained(spark, landing, state, ckpt)
    assert maintain.rewritten(spark, state).where("batch = 2").count() == 0
    write_drop(files(spark, [("shop", "api/app.py", "")]), landing, 3, deleted=True)
    write_drop(files(spark, [("shop", "api/app.py", BACK)]), landing, 2)  # comes late
    maintain.run_maintained(spark, landing, state, ckpt)
    assert dead(spark, state) == []
    write_drop(files(spark, [("shop", "api/app.py", BACK)]), landing, 4)
    maintain.run_maintained(spark, landing, state, ckpt)
    small = state + "-small"
    maintain.compact_views(spark, state, small)
    for at in (state, small):
        assert dead(spark, at) == sorted(both("shop", "itemPrice"))
    write_drop(files(spark, [("bank", "web/f.ts", FRONT % "1")]), landing, 5)
    maintain.run_maintained(spark, landing, small, ckpt)
    assert dead(spark, small) == sorted(both("shop", "itemPrice") + both("bank", "itemName", "itemPrice"))


def test_a_batch_that_is_delivered_again_or_lost_half_way(spark, folders):
    landing, state, _ = folders
    feed = lambda rows: spark.createDataFrame(rows, LANDING_SCHEMA)
    write = maintain._maintain(state)
    first = feed([("shop", "web/f.ts", FRONT % "b.itemName", 1, False), ("shop", "api/app.py", BACK, 1, None)])
    second = feed([("shop", "web/f.ts", FRONT % "1", 2, False), ("shop", "web/f.ts", FRONT % "1", 2, False)])
    write(first, 0)
    write(second, 1)
    want = dead(spark, state)
    assert want == sorted(both("shop", "itemName", "itemPrice"))
    write(second, 1)
    assert dead(spark, state) == want and maintain.rewritten(spark, state).count() == 2
    # views of a batch without its commit are not seen
    maintain._put(spark.createDataFrame([], maintain.SCHEMAS["findings"]), state, "findings", 2)
    assert dead(spark, state) == want


def test_maintained_views_equal_a_full_run(spark, folders):
    landing, state, ckpt = folders
    rng, held = random.Random(3), {}
    for version in range(1, 4):
        rows = []
        for _ in range(6):
            repo, k = rng.choice("abc"), rng.randint(0, 2)
            path, text = rng.choice([(f"web/{k}.ts", FRONT % ", ".join(f"b.{n}" for n in ("itemName", "itemPrice") if rng.random() < .5)),
                                     ("api/app.py", BACK + f"# {rng.random()}")])
            rows = [r for r in rows if r[:2] != (repo, path)] + [(repo, path, text)]
            held[repo, path] = text
        write_drop(files(spark, rows), landing, version)
        maintain.run_maintained(spark, landing, state, ckpt)
    full = Analysis.of(spark, spark.createDataFrame(
        [(r, p, "py" if p.endswith("py") else "ts", c) for (r, p), c in held.items()],
        "repo string, path string, lang string, content string"), persist=False)
    assert dead(spark, state) == sorted((r.repo, r.source, r.path, r.name) for r in full.ledger().collect())


def test_edits_withdraw_until_the_next_scan(spark, folders):
    landing, log, ckpt = folders

    def send(*events):
        spark.createDataFrame(list(events), validity.EVENTS).write.mode("append").parquet(landing)
        validity.run_validity(spark, landing, log, ckpt)
        return {r.path: r.state for r in validity.file_states(spark, log).collect()}

    assert send(("r", "a", "scan", 1), ("r", "b", "scan", 1), ("r", "c", "scan", 1)) == dict.fromkeys("abc", "scanned")
    assert send(("r", "a", "edit", 2), ("r", "b", "edit", 2), ("r", "c", "open", 9), ("r", "d", "edit", 1), ("r", "c", "edit", None)) == {
        "a": "edited", "b": "edited", "c": "scanned", "d": "edited"}
    moves = spark.read.parquet(log).count()
    assert send(("r", "a", "edit", 2), ("r", "b", "scan", 1)) == {"a": "edited", "b": "edited", "c": "scanned", "d": "edited"}
    assert spark.read.parquet(log).count() == moves  # a replay writes nothing
    now = send(("r", "a", "edit", 4), ("r", "a", "save", 5), ("r", "b", "save", 3), ("r", "b", "delete", 3), ("r", "a", "edit", 3))
    assert now == {"a": "scanned", "b": "deleted", "c": "scanned", "d": "edited"}
    findings = spark.createDataFrame([("r", p, p) for p in "abcde"] + [("s", "b", "b")], "repo string, path string, name string")
    left = validity.visible(findings, validity.file_states(spark, log))
    assert sorted((r.repo, r.path) for r in left.collect()) == [("r", "a"), ("r", "c"), ("r", "e"), ("s", "b")]


def test_states_of_files_need_no_python_call_per_file(spark, folders):
    landing, log, ckpt = folders
    big = 2**53 + 1  # beside a missing number a double would round it
    events = spark.createDataFrame([("r", "a", "edit", big), ("r", "a", "edit", None), ("r", None, "edit", 1), (None, None, "scan", 1)], validity.EVENTS)
    assert "Pandas" not in validity.changes(events)._jdf.queryExecution().toString()
    for _ in range(2):
        events.write.mode("append").parquet(landing)
        validity.run_validity(spark, landing, log, ckpt)
    assert spark.read.parquet(log).count() == 3
    got = {(r.repo, r.path, r.state, r.seq) for r in validity.file_states(spark, log).collect()}
    assert got == {("r", "a", "edited", big), ("r", None, "edited", 1), (None, None, "scanned", 1)}


def test_texts_of_a_batch_are_extracted_in_tasks_that_follow_their_number(spark, folders, monkeypatch):
    landing, state, ckpt = folders
    monkeypatch.setattr(rescan, "SAVES_PER_TASK", 50)
    tasks, extract = [], maintain.extract

    def watched(texts):
        tasks.append(texts.rdd.getNumPartitions())
        return extract(texts)

    monkeypatch.setattr(maintain, "extract", watched)
    rows = [("shop", f"api/{i}.py", BACK.replace("items", f"i{i}")) for i in range(600)]
    for _ in range(2):  # delivered twice
        write_drop(files(spark, rows).coalesce(1), landing, 1)
    maintain.run_maintained(spark, landing, state, ckpt)
    assert tasks == [12]
    assert maintain.view(spark, state, "facts").where("ext = 'py_defs'").count() == 1200
