"""Decisions on the analysed tool's quirks, one case each."""
import pytest
from pyspark.sql import functions as F

from deadwire.operators.extract import extract, facts_of


@pytest.fixture(scope="module")
def run(spark):
    def go(path, lang, src, ext):
        df = spark.createDataFrame([("r", path, lang, src)], "repo string, path string, lang string, content string")
        rows = facts_of(extract(df)).filter(F.col("ext") == ext).collect()
        return {(r.name, r.line) for r in rows}
    return go


def test_d2_model_body_does_not_stop_at_letter_z(run):
    src = "class Order(BaseModel):\n    Zone: str\n    zip_code: str\n"
    assert run("m.py", "py", src, "py_defs") == {("Zone", 2), ("zip_code", 3)}


def test_d3_model_body_runs_to_next_class(run):
    src = ("class Item(BaseModel):\n    title: str\n\n\ndef handler():\n    try:\n        pass\n"
           "    except Exception:\n        pass\n\nclass Other:\n    note: str\n")
    got = run("m.py", "py", src, "py_defs")
    assert ("title", 2) in got and ("try", 6) in got      # followed as coded
    assert ("note", 12) not in got                        # next top-level class ends the body


def test_d4_annotated_handler_uses_next_def(run):
    src = ("@app.get('/a')\ndef a() -> dict:\n    return {\"skipped\": 1}\n\n"
           "def b():\n    return {\"taken\": 1}\n")
    assert run("h.py", "py", src, "py_defs") == {("taken", 6)}


def test_d6_generic_request_body_does_not_exclude_dto(run):
    src = ("class UserDto {\n    private String login;\n}\n"
           "class C {\n    void h(@RequestBody List<UserDto> users) {}\n}\n")
    assert run("C.java", "java", src, "java_defs") == {("login", 2)}


def test_d15_array_literal_response_not_handled(run):
    src = "app.get('/x', (req, res) => {\n  res.json([{ a1: 1 }]);\n  res.json({ b2: 1 });\n});\n"
    assert run("s.ts", "ts", src, "ts_response_defs") == {("b2", 3)}


def test_d20_raw_text_rules_read_comments(run):
    src = '    // use @RequestParam with explicit name\n    @GetMapping("/x")\n'
    assert run("C.java", "java", src, "java_reads") == {("name", 1)}
    # the greedy run backtracks to the last lower-case word it can reach
    src2 = "// use @RequestParam with explicit name\nclass C {}\n"
    assert run("C.java", "java", src2, "java_reads") == set()   # 'class' is noise


def test_ts_rules_ignore_comments_and_strings(run):
    src = ("// res.json({ ghost: 1 })\nconst s = 'data.fake';\n/* block\n data.alsoFake */\n"
           "const v = data.real;\n")
    assert run("f.ts", "ts", src, "ts_reads") == {("real", 5)}


def test_unbalanced_body_runs_to_end(run):
    src = 'return jsonify({\n    "first": 1,\n    "second": 2\n'
    assert run("u.py", "py", src, "py_defs") == {("first", 2), ("second", 3)}


def test_unclosed_body_does_not_stop_at_an_opener_outside_routes(run):
    src = ('@app.route("/x")\ndef a():\n    return {\n        "one": 1,\n\n'
           'def b():\n    return {\n        "two": 2,\n\n')
    assert run("v.py", "py", src, "py_defs") == {("one", 4), ("two", 8)}
    twice = src + '@app.route("/y")\ndef c():\n    return {\n        "three": 3,\n    }\n'
    assert run("w.py", "py", twice, "py_defs") == {("one", 4), ("two", 8), ("three", 13)}


def test_deep_nesting_uses_exact_fold(run):
    inner = '{"l1": {"l2": {"l3": {"l4": {"l5": {"l6": 1}}}}}}'
    src = 'x = jsonify({\n    "outer": ' + inner + ',\n    "after": 2\n})\n'
    got = {n for n, _ in run("d.py", "py", src, "py_defs")}
    assert got == {"outer", "l1", "l2", "l3", "l4", "l5", "l6", "after"}


def test_go_bind_target_resolution_priority(run):
    src = ("type A struct {\n\tX string `json:\"ax\"`\n}\ntype B struct {\n\tY string `json:\"by\"`\n}\n"
           "func h(c *gin.Context, req B) {\n\tvar req A\n\tc.ShouldBindJSON(&req)\n}\n")
    # var declaration wins over the parameter form
    assert run("h.go", "go", src, "go_reads") == {("ax", 9)}
    assert run("h.go", "go", src, "go_defs") == {("by", 5)}
