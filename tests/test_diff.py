"""Diff semantics and an end-to-end field set on the integration fixtures."""
import json

from pyspark.sql import functions as F

from deadwire.operators.diff import compute_diff, run_diff

SCHEMA = "name string, side string, path string, line int"


def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def names(d):
    return sorted(r.name for r in d.collect())


def test_nothing_all_or_none_accessed(spark):
    defined = df(spark, [("id", "response", "a", 1), ("name", "response", "a", 2)])
    empty = df(spark, [])
    assert names(compute_diff(defined, empty)) == ["id", "name"]
    assert names(compute_diff(defined, defined)) == []
    assert names(compute_diff(empty, empty)) == []


def test_extra_accessed_ignored_and_case_sensitive(spark):
    defined = df(spark, [("email", "response", "a", 1)])
    assert names(compute_diff(defined, df(spark, [("email", "response", "b", 9),
                                                  ("unrelated", "response", "b", 9)]))) == []
    assert names(compute_diff(defined, df(spark, [("Email", "response", "b", 1)]))) == ["email"]


def test_metadata_duplicates_and_side_kept(spark):
    defined = df(spark, [("token", "request", "x.ts", 3), ("token", "request", "y.ts", 4)])
    out = compute_diff(defined, df(spark, [("other", "response", "z", 1)])).collect()
    assert sorted((r.path, r.line, r.side) for r in out) == [("x.ts", 3, "request"), ("y.ts", 4, "request")]
    # side is ignored when matching names
    assert compute_diff(defined, df(spark, [("token", "response", "z", 1)])).count() == 0


def test_run_diff_scores_and_keeps_inputs(spark):
    defined = df(spark, [("userId", "response", "a", 1), ("isActive", "response", "a", 2)]) \
        .withColumn("pattern", F.lit("GET /api/users"))
    accessed = df(spark, [("isActive", "response", "b", 1)])
    before = defined.collect()
    out = {r.name: r.waste_score for r in run_diff(defined, accessed).collect()}
    assert out == {"userId": 38 * 10_000}
    assert defined.collect() == before and "waste_score" not in defined.columns
    no_pattern = run_diff(defined.drop("pattern"), accessed, pattern_col=None).first()
    assert no_pattern.waste_score == 38 * 10_000


def test_keyed_diff(spark):
    d = spark.createDataFrame([("r1", "a"), ("r2", "a")], "repo string, name string")
    a = spark.createDataFrame([("r1", "a")], "repo string, name string")
    assert [r.repo for r in compute_diff(d, a, ["repo"]).collect()] == ["r2"]


def test_integration_field_set(spark, fixture_analysis):
    """Frontend reads of the orders client against hand-built definitions:
    exactly the four unread names are dead."""
    reads = fixture_analysis.facts.filter(F.col("path").endswith("orders_client.ts")
                                          & (F.col("ext") == "ts_reads"))
    assert names(reads) == ["id", "status", "total"]
    defined = df(spark, [(n, "response", "orders_server.ts", 1) for n in
                         ["id", "total", "status", "createdAt", "customerId", "notes", "internalRef"]])
    assert names(compute_diff(defined, reads)) == ["createdAt", "customerId", "internalRef", "notes"]


def test_integration_endpoints(spark, fixture_analysis):
    eps = {r.pattern: r for r in fixture_analysis.endpoints().collect()}
    assert eps["GET /api/orders"].backend_file.endswith("orders_server.ts")
    assert eps["GET /api/orders"].n_frontend == 1
    assert eps["POST /api/orders"].n_frontend == 2  # the unit fetch fixture posts there too
    # POST /api/orders: TS backend response defs vs the callers' reads
    dead = {(r.pattern, r.name) for r in fixture_analysis.dead_fields().collect()}
    assert ("POST /api/orders", "accepted") in dead and ("POST /api/orders", "orderRef") in dead
    # the Java endpoint: frontend request body vs backend reads
    assert ("POST /accounts", "plan") in dead
    assert not {("POST /accounts", n) for n in ["givenName", "familyName", "mailbox"]} & dead


def test_global_fallback(spark, fixture_analysis):
    g = {(r.path.split("/")[-1], r.name) for r in fixture_analysis.global_dead().collect()}
    # response defs never read by any TS file of the repo; 'status' is read by the client
    assert ("AccountDto.java", "displayTitle") in g
    assert ("http_api.go", "status") not in g
    assert ("flask_app.py", "accountId") in g
    # request-side model fields are not part of the global pass
    assert ("fastapi_app.py", "handle") not in g


def test_report_sink(spark, fixture_analysis, tmp_path):
    """Fact tables as parquet and the JSON report: sorted endpoints and a child document per list."""
    from deadwire.sources.files import write_report
    out = str(tmp_path / "report")
    write_report(fixture_analysis, out)
    eps = spark.read.json(f"{out}/report/endpoints").collect()
    by = {r.pattern: r for r in eps}
    assert by["POST /accounts"].deadFields == 1
    assert by["POST /accounts"].backendFile.endswith("AccountController.java")
    read = lambda name: spark.read.json(f"{out}/report/{name}")
    of = lambda name: read(name).filter("pattern = 'POST /accounts'")
    assert [r.name for r in of("deadFields").collect()] == ["plan"]
    assert of("frontendFiles").count() == by["POST /accounts"].frontendFiles
    assert of("definedFields").count() == by["POST /accounts"].definedFields
    assert of("accessedFields").count() == by["POST /accounts"].accessedFields
    assert read("global").filter(F.col("definedAt").contains("AccountDto.java:")).count() == 5
    lines = []
    for part in sorted((tmp_path / "report" / "report" / "endpoints").glob("part-*")):
        lines += [json.loads(x)["pattern"] for x in part.read_text().splitlines()]
    assert lines == [r.pattern for r in fixture_analysis.endpoints_sorted().collect()]
    facts = spark.read.parquet(f"{out}/facts")
    assert set(r.lang for r in facts.select("lang").distinct().collect()) == {"py", "java", "go", "ts"}


def test_scan_excludes_dirs_and_dts(spark, tmp_path):
    from deadwire.sources.files import scan_corpus
    root = tmp_path / "corpus"
    for rel, text in [("shop/src/a.ts", "x.y"), ("shop/node_modules/lib/b.ts", "x.z"),
                      ("shop/types/c.d.ts", "declare const q: any"), ("blog/app.py", "pass"),
                      ("blog/a b+c%20/d e.py", "pass"), ("blog/README.md", "# no"), ("blog/dist/out.js", "1")]:
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {(r.repo, r.path, r.lang) for r in scan_corpus(spark, str(root)).collect()}
    assert got == {("shop", "shop/src/a.ts", "ts"), ("shop", "shop/types/c.d.ts", "ts"),
                   ("blog", "blog/app.py", "py"), ("blog", "blog/a b+c%20/d e.py", "py")}
    glob = {(r.repo, r.path) for r in scan_corpus(spark, f"{root}/*").collect()}
    assert glob == {(a, b) for a, b, _ in got}
    no_dts = {r.path for r in scan_corpus(spark, str(root), include_dts=False).collect()}
    assert "shop/types/c.d.ts" not in no_dts


def test_corpus_table_source(spark, tmp_path):
    from deadwire.sources.files import read_corpus_table
    rows = [("shop", "web/a.ts", "x.itemName"), ("shop", "notes.txt", "ignored")]
    spark.createDataFrame(rows, "repo string, path string, content string").write.parquet(str(tmp_path / "t"))
    got = {(r.repo, r.path, r.lang) for r in read_corpus_table(spark, str(tmp_path / "t")).collect()}
    assert got == {("shop", "web/a.ts", "ts")}


def test_first_finding_on_a_line_is_the_first_by_position(spark):
    """Not the first by name."""
    from deadwire.plans.pipeline import Analysis
    files = spark.createDataFrame([("r", "api/a.py", "py", "from flask import jsonify\n@app.route('/x')\ndef x():\n"
                                    "    return jsonify({'zeta1': 1, 'alpha1': 2})\n")],
                                  "repo string, path string, lang string, content string")
    a = Analysis.of(spark, files)
    got = a.position_lookup(spark.createDataFrame([("r", "api/a.py", 4)], "repo string, path string, line int")).collect()
    assert [r.name for r in got] == ["zeta1"]
    assert [(r.lang, r.n_files) for r in a.lang_file_counts().collect()] == [("py", 1)]
    a.close()
