"""Large and pathological inputs: no stack overflow in the regex engine, and
time grows with the text, not with its square."""
import time

from pyspark.sql import functions as F

from deadwire.operators.extract import extract, facts_of, routes_of


def _facts(spark, path, lang, src):
    df = spark.createDataFrame([("r", path, lang, src)], "repo string, path string, lang string, content string")
    return {(r.ext, r.name) for r in facts_of(extract(df)).collect()}


def test_long_string_literals(spark):
    blob = "A" * 200_000
    src = f"const img = '{blob}';\nconst t = `{blob}`;\nconst v = data.realField;\n"
    assert ("ts_reads", "realField") in _facts(spark, "big.ts", "ts", src)


def test_many_nested_objects_in_one_literal(spark):
    items = ",\n".join('    "k%d": {"v": %d}' % (i, i) for i in range(3000))
    src = "x = jsonify({\n" + items + "\n})\n"
    got = _facts(spark, "big.py", "py", src)
    assert ("py_defs", "k0") in got and ("py_defs", "k2999") in got


def test_large_file_scales(spark):
    line = "  out.push(body.field{i});\n"
    src = "export function f(body: any) {\n" + "".join(line.format(i=i) for i in range(20_000)) + "}\n"
    t = time.time()
    got = _facts(spark, "huge.ts", "ts", src)
    assert len([1 for e, n in got if e == "ts_reads"]) == 20_000
    assert time.time() - t < 120


def _spans_by_scan(text):
    """Route bodies by the definition: scan every line after each decorated head."""
    import re
    from deadwire.operators.rules_py import DEF_HEAD, ROUTE_DECORATOR
    out, lines = set(), text.split("\n")
    indent = lambda s: len(s) - len(s.lstrip())
    for m in re.finditer(ROUTE_DECORATOR + r"(?=[\s\S]*?(" + DEF_HEAD + r")([^\n]*))", text, re.ASCII):
        at = text.count("\n", 0, m.end(1)) + 1
        rest = [i for i in range(at + 1, len(lines) + 1) if lines[i - 1].strip()]
        need = indent(m[2]) if m[2].strip() else indent(lines[rest[0] - 1]) if rest else -1
        end = next((i for i in rest if indent(lines[i - 1]) < need), len(lines) + 1)
        out |= set(range(at, end))
    return out


def test_route_bodies_against_a_scan():
    import random
    from deadwire.operators.rules_py import in_routes
    rng = random.Random(5)
    parts = ["@app.get('/a')", "def f(x):", "def g(a,\n   b):  return 1", "    return {", "        x", "", "  y", "z = 1",
             "\t", "    @app.route('/b')", "    def h(self):", "# def k(", "    }"]
    for _ in range(400):
        text = "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        n = text.count("\n") + 1
        want = _spans_by_scan(text)
        assert in_routes(text, list(range(1, n + 1))) == [i in want for i in range(1, n + 1)], text


def test_many_routes_in_one_file(spark):
    src = "".join(f"@app.get('/r{i}')\ndef f{i}():\n    return {{\"k{i}\": 1}}\n\n" for i in range(8000))
    t = time.time()
    got = _facts(spark, "routes.py", "py", src)
    assert len([1 for e, _ in got if e == "py_defs"]) == 8000
    assert time.time() - t < 60


def _routes(spark, path, lang, src):
    df = spark.createDataFrame([("r", path, lang, src)], "repo string, path string, lang string, content string")
    return [(r.rule, r.method, r.url) for r in routes_of(extract(df)).collect()]


def test_calls_are_found_as_by_the_patterns():
    """The linear search against the three patterns as they are stated."""
    import random
    import re
    from deadwire.functions.calls import calls_of
    q = "['\"`]"
    stated = {
        "chained": rf"(?:router|app)\.route\({q}(.*?){q}\)\s*(?:\.[a-z]+\([^)]*\)\s*)*\.(get|post|put|delete|patch)\(",
        "fetch": rf"fetch\({q}(.*?){q}(?:\s*,\s*(\{{[\s\S]*?\}}))?\s*\)",
        "do_fetch": r"this\.doFetch(?:WithResponse)?(?:<[^>]+>)?\(\s*([\s\S]*?),\s*(\{[\s\S]*?\})\s*\)"}
    parts = ["app.route('", "router.route(`", "'", ")", "('", "')", ".get(", ".post(a)", ".all(x)", " ", "\n", "fetch('",
             "fetch(`", ", {", "{", "}", "})", "} )", "this.doFetch(", "this.doFetchWithResponse<", "<T>(", ">", "(", "a",
             "'x'", ",", "',{", "' )", ".x('q')", "\t", ".route("]
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 18)))
        want = [(rule, m[1], m[2] or "") for rule, p in stated.items() for m in re.finditer(p, text, re.ASCII)]
        assert calls_of(text) == want, text


def test_long_chains_and_unclosed_calls_are_linear(spark):
    _routes(spark, "warm.ts", "ts", "fetch('/a')")
    cases = [("app.route('/x')" + ".all(a).get(b)" * 20_000, [("chained", "GET", "/x")]),
             ("app.route('/x')" + ".x('b')" * 140_000, []), ("app.route('/x')\n" * 60_000, []),
             ("fetch('a', {\n" * 80_000, []), ("fetch('a',{" * 90_000, []), ("this.doFetch(x, {\n" * 60_000, []),
             ("this.doFetch<" * 70_000, []), ("fetch('/a', {\n" * 40_000 + "})", [("fetch", "GET", "/a")])]
    for src, want in cases:
        t = time.time()
        assert _routes(spark, "web/a.ts", "ts", src) == want
        assert time.time() - t < 15, src[:40]


def test_many_annotations(spark):
    body = "@X(1) " * 20_000 + '@JsonProperty("named") private String first;\n' + "@Y\n" * 20_000 + "int x() {}\n" \
        + "@Z public int second = 1;\n"
    src = "class A {\n" + body + "}\nvoid h(@RequestBody B b) { use(b); }\nclass B {" + "@X(1) " * 20_000 + "private int third;}\n"
    t = time.time()
    assert _facts(spark, "A.java", "java", src) == {("java_defs", "named"), ("java_defs", "second"), ("java_reads", "third")}
    assert time.time() - t < 60


def test_many_go_binds(spark):
    src = "package a\n" + "".join(f"type T{i} struct {{\n\tF string `json:\"k{i}\"`\n}}\n" for i in range(800)) \
        + "func h(c *gin.Context) {\n" + "".join(f"\tvar v{i} T{i}\n\tc.BindJSON(&v{i})\n" for i in range(800)) + "}\n"
    _facts(spark, "warm.go", "go", "package a\n")
    t = time.time()
    got = _facts(spark, "a.go", "go", src)
    assert got == {("go_reads", f"k{i}") for i in range(800)}
    assert time.time() - t < 20


def test_go_types_by_priority(spark):
    src = ("package a\ntype A struct {\n\tX string `json:\"aa\"`\n}\ntype B struct {\n\tX string `json:\"bb\"`\n}\n"
           "type C struct {\n\tX string `json:\"cc\"`\n}\nfunc f(p A, q B) {\n\tq := C{}\n\tr := B{}\n\tvar r A\n"
           "\tc.BindJSON(&p)\n\tc.BindJSON(&q)\n\tc.BindJSON(&r)\n\tc.BindJSON(&none)\n}\n")
    df = spark.createDataFrame([("r", "a.go", "go", src)], "repo string, path string, lang string, content string")
    got = [(r.name, r.line) for r in facts_of(extract(df)).collect() if r.ext == "go_reads"]
    assert got == [("aa", 15), ("cc", 16), ("aa", 17)]


def test_offsets_and_lines_of_matches(spark):
    import random
    import re
    from deadwire.functions.text import MARK, MARK_END, match_lines, match_offsets
    rng = random.Random(2)
    texts = ["", "x", "aXb", "X\nX", MARK, f"{MARK}X{MARK_END}\n{MARK}{MARK}X\n{MARK_END}X", "é😀X\n\nXX"]
    texts += ["".join(rng.choice(["X", "Xy", "a", "\n", MARK, MARK_END, "é", "😀"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in ("X", "Xy?", f"[X{MARK}]", "X\n"):
        for r in df.select("i", match_lines("t", pattern).alias("l"), match_offsets("t", pattern).alias("o")).collect():
            text = texts[r.i]
            want = [(m.start(), text.count("\n", 0, m.start()) + 1, m[0]) for m in re.finditer(pattern, text)]
            assert [tuple(o) for o in r.o] == want and r.l == [w[1] for w in want], (pattern, text)


def test_private_use_characters_stay_in_the_text(spark):
    src = "const a = b.x;\nfetch('/ab')\nconst c = d.named;\n"
    assert _routes(spark, "a.ts", "ts", src) == [("fetch", "GET", "/ab")]
    lines = "\n{\n\"k\": 1}\n" + "def f():\n" + "x = jsonify({'kept': 1})\n"
    df = spark.createDataFrame([("r", "a.py", "py", lines)], "repo string, path string, lang string, content string")
    assert [(r.name, r.line) for r in facts_of(extract(df)).collect()] == [("kept", 5)]
