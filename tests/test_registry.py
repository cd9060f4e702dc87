"""A language added from outside: rows of the registry, no edit of the library."""
import pytest
from pyspark.sql import functions as F

from deadwire.functions.text import pick, scan
from deadwire.operators.registry import RULES, Extractor, Language
from deadwire.operators.rules_py import fact
from deadwire.plans.pipeline import Analysis
from deadwire.sources.files import scan_corpus

RUBY = Language("ruby", r"\.rb$", 4, {"render": (r"render json: \{", "render json")})


def ruby_defs(file):
    def keys(body):
        return F.transform(scan(body["body"], r"([a-z_]+):", {"k": 1}), lambda x: fact(
            "response", "ruby_render", 1, x["k"], body["line"] + x["line"] - 1))
    return F.flatten(F.transform(pick(file.found, "render"), keys))


def ruby_reads(file):
    return F.transform(scan(file.content, r"params\[:([a-z_]+)\]", {"k": 1}), lambda x: fact(
        "request", "ruby_params", 1, x["k"], x["line"]))


def with_ruby():
    return RULES.with_rows([RUBY], [Extractor("ruby", "def", "ruby_defs", ruby_defs, answers_endpoint=True, answers_global=True),
                                    Extractor("ruby", "read", "ruby_reads", ruby_reads)])


def test_a_fifth_language(spark, tmp_path):
    shop = tmp_path / "shop"
    shop.mkdir()
    (shop / "api.rb").write_text("app.get('/api/things') do\n  q = params[:sort]\n  render json: {\n    thing_name: 1,\n"
                                 "    thing_size: 2 }\nend\n")
    (shop / "web.ts").write_text("async function f() {\n  const r = await fetch('/api/things');\n  return r.thing_name;\n}\n")
    (shop / "other.py").write_text("def f():\n    return 1\n")
    rules = with_ruby()
    files = scan_corpus(spark, str(tmp_path), rules=rules, extensions=["rb", "ts", "py"])
    assert {r.lang for r in files.collect()} == {"ruby", "ts", "py"}
    a = Analysis.of(spark, files, persist=False, rules=rules)
    assert {(r.ext, r.name, r.line) for r in a.facts.collect() if r.lang == "ruby"} == {
        ("ruby_defs", "thing_name", 4), ("ruby_defs", "thing_size", 5), ("ruby_reads", "sort", 2)}
    assert [(r.backend_file, r.backend_lang) for r in a.endpoints().collect()] == [("shop/api.rb", "ruby")]
    assert [(r.pattern, r.name) for r in a.dead_fields().collect()] == [("GET /api/things", "thing_size")]
    assert [r.name for r in a.global_dead().collect()] == ["thing_size"]
    # the built-in registry is as it was
    assert {r.ext for r in Analysis.of(spark, files, persist=False).facts.collect()} == {"ts_reads"}


def test_names_are_taken_once():
    for rows in (([Language("py", r"\.pyx$", 9)], []), ([], [Extractor("py", "def", "py_defs", ruby_defs)]),
                 ([], [Extractor("ruby", "def", "ruby_defs", ruby_defs)])):
        with pytest.raises(ValueError):
            RULES.with_rows(*rows)
