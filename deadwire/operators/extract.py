"""One narrow pass over the corpus: every file row yields its routes/calls
and its field facts. No shuffle; ``content`` is dropped right here so it never
rides a later exchange.

Extractors (``ext``) and the dedup key each uses, first occurrence kept:

=================  =====================  ======================
ext                rules                  dedup key
=================  =====================  ======================
py_defs            E18, E19               name, line
py_reads           E20, E21               name, line
java_defs          E22                    name, line
java_reads         E23, E24               name, line
go_defs            E25                    name, line
go_reads           E26                    name, line
ts_request_defs    E11-E14                name, line
ts_response_defs   E15                    name
ts_reads           E16, E17               name
ts_dynamic         D1 flag                one per file
=================  =====================  ======================
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deadwire.functions.calls import calls
from deadwire.functions.text import bodies, let
from deadwire.operators import rules_go, rules_py, rules_ts
from deadwire.operators.registry import RULES, FileColumns, Rules
from deadwire.operators.routes import route_facts

def _first_wins(arr: Column, ext: str, by_line: bool) -> Column:
    """Keep the first element per dedup key, in array order."""
    keyed = F.transform(arr, lambda x, i: F.struct(
        (F.concat_ws("\u0001", x["name"], x["line"].cast("string")) if by_line else x["name"]).alias("k"),
        i.alias("i"), x.alias("f")))
    kept = let(F.array_sort(keyed), lambda srt: F.filter(
        srt, lambda x, i: (i == 0) | (x["k"] != F.element_at(srt, F.greatest(i, F.lit(1)))["k"])))
    kept = F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["f"].alias("f"))))
    return F.transform(kept, lambda x: F.struct(F.lit(ext).alias("ext"), x["f"]["side"].alias("side"),
                                               x["f"]["rule"].alias("rule"), x["f"]["name"].alias("name"),
                                               x["f"]["line"].alias("line")))


def _facts_for(rules: Rules, lang: Column, file: FileColumns, ts: Column) -> Column:
    parts = [F.when(lang == x.lang, _first_wins(x.fn(file), x.ext, x.by_line)) for x in rules.extractors if x.fn is not None]
    typed_empty = F.filter(_first_wins(rules_py.empty(), "x", True), lambda x: F.lit(False))
    return F.concat(*[F.coalesce(p, typed_empty) for p in (*parts, ts)])


_BUILT: dict = {}


def _columns(rules: Rules):
    """The extraction expressions, built once per driver JVM and registry: they depend only
    on column names, and building them costs thousands of driver calls."""
    from pyspark import SparkContext
    key = id(SparkContext._gateway), rules
    if key not in _BUILT:
        content, lang = F.col("content"), F.col("lang")
        _BUILT[key] = (
            rules_ts.ts_facts(lang, content).alias("ts"),
            bodies(lang, content, {x.name: x.bodies for x in rules.languages if x.bodies},
                   {name: test for x in rules.languages for name, test in x.body_tests.items()}).alias("found"),
            F.when(lang == "go", rules_go.structs(F.col("found"))).alias("sts"),
            F.when(lang == "go", rules_go.declared_types(content)).alias("types"),
            calls(content).alias("calls"),
            route_facts(content, F.col("calls")).alias("routes"),
            _facts_for(rules, lang, FileColumns(content, F.col("found"), F.col("sts"), F.col("types")), F.col("ts"))
            .alias("facts"),
        )
    return _BUILT[key]


def extract(files: DataFrame, keep: list[str] | None = None, rules: Rules = RULES) -> DataFrame:
    """files(repo, path, lang, content) -> one row per file with two arrays:
    ``routes`` and ``facts`` (plus any ``keep`` columns). Narrow: one
    projection chain, no exchange. ``rules``: the registry to look extractors up in."""
    keep = list(keep or [])
    ts, found, sts, types, called, routes, facts = _columns(rules)
    f = files.select("repo", "path", "lang", "content", *keep)
    # per-file values computed once: TypeScript facts, bodies and calls, then Go structs from the bodies
    f = f.select("repo", "path", "lang", "content", *keep, ts, found, called)
    f = f.select("repo", "path", "lang", "content", *keep, "ts", "found", "calls", sts, types)
    return f.select("repo", "path", "lang", *keep, routes, facts)


def routes_of(extracted: DataFrame, keep: list[str] | None = None, rules: Rules = RULES) -> DataFrame:
    """routes(repo, path, lang, lang_rank, role, rule, method, url)."""
    return (extracted.select("repo", "path", "lang", *(keep or []), F.inline("routes"))
            .withColumn("lang_rank", rules.rank_of(F.col("lang"))))


def _numbered(facts: Column) -> Column:
    return F.transform(facts, lambda x, i: F.struct(*(x[c].alias(c) for c in ("ext", "side", "rule", "name", "line")),
                                                    i.alias("pos")))


def facts_of(extracted: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """fields(repo, path, lang, ext, side, rule, name, line, pos); ``pos`` numbers a file's fields in
    the order of extraction."""
    return extracted.select("repo", "path", "lang", *(keep or []), F.inline(_numbered(F.col("facts"))))


def flat_facts(extracted: DataFrame) -> DataFrame:
    """Files (ext = 'file'), routes and calls ('route') and field facts as one flat table, so it can be written once, partitioned by ``ext``, and every
    query prunes to the partitions it needs."""
    null = lambda t: F.lit(None).cast(t)
    r = F.transform(F.col("routes"), lambda x: F.struct(
        F.lit("route").alias("ext"), null("string").alias("side"), x["rule"].alias("rule"),
        null("string").alias("name"), null("int").alias("line"), null("int").alias("pos"), x["role"].alias("role"),
        x["method"].alias("method"), x["url"].alias("url")))
    f = F.transform(_numbered(F.col("facts")), lambda x: F.struct(
        x["ext"].alias("ext"), x["side"].alias("side"), x["rule"].alias("rule"), x["name"].alias("name"),
        x["line"].alias("line"), x["pos"].alias("pos"), null("string").alias("role"), null("string").alias("method"),
        null("string").alias("url")))
    one = F.array(F.struct(F.lit("file").alias("ext"), *(null("string").alias(c) for c in ("side", "rule", "name")),
                           null("int").alias("line"), null("int").alias("pos"),
                           *(null("string").alias(c) for c in ("role", "method", "url"))))
    return extracted.select("repo", "path", "lang", F.inline(F.concat(one, r, f)))


def routes_from_flat(flat: DataFrame, rules: Rules = RULES) -> DataFrame:
    return (flat.filter(F.col("ext") == "route")
            .select("repo", "path", "lang", "role", "rule", "method", "url",
                    rules.rank_of(F.col("lang")).alias("lang_rank")))


def facts_from_flat(flat: DataFrame) -> DataFrame:
    return (flat.filter(~F.col("ext").isin("route", "file"))
            .select("repo", "path", "lang", "ext", "side", "rule", "name", "line", "pos"))
