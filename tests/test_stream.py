"""Incremental re-analysis: saves arrive as versioned drops; the latest
version of each file wins, and an edited file's old facts are retracted."""
import os
import tempfile

from pyspark.sql import functions as F

from deadwire.streaming.rescan import LANDING_SCHEMA, _batch_writer, compact, current_state, run_rescan, write_drop

FRONT_V1 = "export async function f() {\n  const r = await fetch('/api/items');\n  const b = await r.json();\n  return [b.itemName, b.itemPrice];\n}\n"
FRONT_V2 = "export async function f() {\n  const r = await fetch('/api/items');\n  const b = await r.json();\n  return [b.itemName];\n}\n"
BACK = "from flask import jsonify\n@app.route('/api/items')\ndef items():\n    return jsonify({'itemName': 1, 'itemPrice': 2, 'itemSku': 3})\n"


def files(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, lang string, content string")


def test_stream_latest_version_wins(spark):
    base = tempfile.mkdtemp(prefix="deadwire-stream-test-")
    landing, state, ckpt = (os.path.join(base, x) for x in ("landing", "state", "ckpt"))
    write_drop(files(spark, [("shop", "web/f.ts", "ts", FRONT_V1), ("shop", "api/app.py", "py", BACK)]),
               landing, 1)
    run_rescan(spark, landing, state, ckpt)
    dead1 = {r.name for r in current_state(spark, state).dead_fields().collect()}
    assert dead1 == {"itemSku"}
    # the frontend is saved again without one read: only that file is re-analysed
    write_drop(files(spark, [("shop", "web/f.ts", "ts", FRONT_V2)]), landing, 2)
    run_rescan(spark, landing, state, ckpt)
    st = current_state(spark, state)
    assert {r.name for r in st.dead_fields().collect()} == {"itemSku", "itemPrice"}
    # both batches were logged, the second held only the changed file
    log = spark.read.parquet(os.path.join(state, "files_log"))
    assert log.filter(F.col("version") == 2).count() == 1
    assert st.files.count() == 2


def test_stream_deletes_and_duplicates(spark):
    base = tempfile.mkdtemp(prefix="deadwire-stream-test-")
    landing, state, ckpt, small = (os.path.join(base, x) for x in ("landing", "state", "ckpt", "small"))
    front = files(spark, [("shop", "web/f.ts", "ts", FRONT_V2)])
    both = front.union(files(spark, [("shop", "api/app.py", "py", BACK), ("shop", "web/g.ts", "ts", FRONT_V1)]))
    write_drop(both, landing, 1)
    write_drop(both, landing, 1)
    run_rescan(spark, landing, state, ckpt, max_files_per_trigger=1)
    st = current_state(spark, state)
    assert sorted(r.name for r in st.dead_fields().collect()) == ["itemSku"] and st.files.count() == 3
    write_drop(front.withColumn("path", F.lit("web/g.ts")), landing, 2, deleted=True)
    write_drop(both, landing, 1)  # late and older than the deletion
    run_rescan(spark, landing, state, ckpt)
    st = current_state(spark, state)
    assert sorted(r.name for r in st.dead_fields().collect()) == ["itemPrice", "itemSku"] and st.files.count() == 2
    compact(spark, state, small)
    st = current_state(spark, small)
    assert sorted(r.name for r in st.dead_fields().collect()) == ["itemPrice", "itemSku"] and st.files.count() == 2
    assert spark.read.parquet(os.path.join(small, "files_log")).count() == 3
    run_rescan(spark, landing, small, ckpt)  # nothing new
    assert current_state(spark, small).files.count() == 2


def test_tasks_of_a_batch_follow_its_saves(spark):
    state = os.path.join(tempfile.mkdtemp(prefix="deadwire-stream-test-"), "state")
    rows = [("shop", f"api/{i % 300}.py", BACK, 1 + i // 300, False) for i in range(600)]
    batch = spark.createDataFrame(rows, LANDING_SCHEMA).repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        _batch_writer(state)(batch, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    log = spark.read.parquet(f"{state}/files_log")
    assert log.count() == 300 and log.where("version = 2").count() == 300
    assert len([f for f in os.listdir(f"{state}/files_log/batch=0") if f.endswith(".parquet")]) <= 3
    facts = spark.read.parquet(f"{state}/facts_log")
    assert facts.where("ext = 'py_defs'").count() == 900
