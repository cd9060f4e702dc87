"""Go rules: response definitions (E25, J5) and request reads."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deadwire.functions.noise import is_noise
from deadwire.functions.scalars import json_tag_name
from deadwire.functions.text import let, nl, pick, scan
from deadwire.operators.rules_py import fact, nz

IDENT = r"[a-zA-Z_][a-zA-Z0-9_]*"
# --- fixed values: Go rule patterns -------------------------------------------
BIND_TARGET = r"(?:ShouldBindJSON|BindJSON|\.Decode)\s*\(\s*&\s*(" + IDENT + r")\s*\)"
GIN_H = r"\bgin\.H\s*\{"
MAP_LITERAL = r"\bmap\[string\](?:interface\s*\{\s*\}|any)\s*\{"
STRING_KEY = r"\"(" + IDENT + r")\"\s*:"
STRUCT_HEAD = r"\btype\s+([A-Z][a-zA-Z0-9_]*)\s+struct\s*\{"
STRUCT_FIELD = r"(?m)^[ \t]+([A-Za-z][a-zA-Z0-9_]*)[ \t]+\S[^\n`]*(`[^`]*`)?[ \t]*$"
JSON_TAG = r"`[^`]*json:\"([^\"]*)\"[^`]*`"
GIN_BIND = r"\.(?:ShouldBindJSON|BindJSON)\s*\(\s*&\s*(" + IDENT + r")\s*\)"
DECODE = r"\.Decode\s*\(\s*&\s*(" + IDENT + r")\s*\)"
QUERY = r"\.Query\s*\(\s*\"(" + IDENT + r")\"\s*\)"
QUERY_GET = r"\.Query\(\)\.Get\s*\(\s*\"(" + IDENT + r")\"\s*\)"
POST_FORM = r"\.PostForm\s*\(\s*\"(" + IDENT + r")\"\s*\)"
FORM_VALUE = r"\.FormValue\s*\(\s*\"(" + IDENT + r")\"\s*\)"


# Declarations with name and type, in order of priority. What follows the name is looked at and not taken, so
# that a type can be the next one's name.
DECLARATIONS = (r"\bvar(?=\s+(" + IDENT + r")\s+([A-Z][a-zA-Z0-9_]*)\b)",
                r"\b(" + IDENT + r")(?=\s*:=\s*([A-Z][a-zA-Z0-9_]*)\s*\{)",
                r"\b(" + IDENT + r")(?=\s+([A-Z][a-zA-Z0-9_]*)\b)")


def declared_types(content: Column) -> Column:
    """map<variable, type> of a file (J8): ``var v T`` over ``v := T{`` over a parameter ``v T``, the first of each form.
    Every form is searched once per file, whatever the number of variables."""
    def of_form(form: int, pattern: str) -> Column:
        both = F.arrays_zip(*(F.regexp_extract_all(content, F.lit(pattern), g).alias(n) for g, n in ((1, "v"), (2, "t"))))
        return F.transform(both, lambda x, i: F.struct(
            x["v"].alias("v"), F.lit(form).alias("form"), i.alias("i"), x["t"].alias("t")))

    found = F.concat(*(of_form(i, p) for i, p in enumerate(DECLARATIONS)))
    first = let(F.array_sort(found), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (F.element_at(s, F.greatest(i, F.lit(1)))["v"] != x["v"])))
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["v"].alias("v"), x["t"].alias("t"))))


BODY_RULES = {"struct": (STRUCT_HEAD, "struct"), "gin.H": (GIN_H, "gin.H"), "map": (MAP_LITERAL, "map[string]")}


def structs(found: Column) -> Column:
    """array<struct<name, fields: array<struct<json, line>>>> of every
    ``type X struct {..}`` declaration; json is null for ``json:"-"``."""
    heads = pick(found, "struct")

    def one(h):
        fl = scan(h["body"], STRUCT_FIELD, {"go": 1})
        fs = F.transform(fl, lambda f: F.struct(
            json_tag_name(f["go"], F.when(f["m"].rlike(JSON_TAG),
                                          F.regexp_extract(f["m"], JSON_TAG, 1))).alias("json"),
            (h["line"] + nl(h["m"]) + f["line"] - 1).alias("line")))
        return F.struct(h["g"].alias("name"), F.filter(fs, lambda f: f["json"].isNotNull()).alias("fields"))

    return F.transform(heads, one)


def go_defs(content: Column, found: Column, sts: Column, types: Column) -> Column:
    """gin.H and map literals' string keys; struct fields of non-bound types. ``types``: ``declared_types``."""
    noise = lambda n: is_noise(n, "go", "def")

    def keys(bodies, rule, order):
        def per(o):
            ks = F.filter(scan(o["body"], STRING_KEY, {"k": 1}), lambda k: ~noise(k["k"]))
            return F.transform(ks, lambda k: fact("response", rule, order, k["k"],
                                                  o["line"] + nl(o["m"]) + k["line"] - 1))
        return F.flatten(F.transform(bodies, per))

    a = keys(pick(found, "gin.H"), "go_gin_h", 1)
    b = keys(pick(found, "map"), "go_map_literal", 2)
    bound = F.transform(F.regexp_extract_all(content, F.lit(BIND_TARGET), 1),
                        lambda v: F.element_at(types, v))
    keep = let(bound, lambda bd: F.filter(
        sts, lambda s: ~F.coalesce(F.array_contains(bd, s["name"]), F.lit(False))))
    c = F.flatten(F.transform(keep, lambda s: F.transform(
        F.filter(s["fields"], lambda f: ~noise(f["json"])),
        lambda f: fact("response", "go_struct", 3, f["json"], f["line"]))))
    return F.concat(nz(a), nz(b), nz(c))


def go_reads(content: Column, sts: Column, types: Column) -> Column:
    """Bound structs' fields (all of them), query and form parameters. ``types``: ``declared_types``."""
    noise = lambda n: is_noise(n, "go", "read")

    def bound(pattern, rule, order, guard):
        calls = scan(content, pattern, {"v": 1}, guard=guard)

        def per(cl):
            of_type = let(F.element_at(types, cl["v"]), lambda t: F.filter(sts, lambda s: s["name"] == t))
            names = F.flatten(F.transform(of_type, lambda s: F.transform(s["fields"], lambda f: f["json"])))
            return F.transform(F.filter(names, lambda n: ~noise(n)),
                               lambda n: fact("request", rule, order, n, cl["line"]))
        return nz(F.flatten(F.transform(calls, per)))

    def simple(pattern, rule, order, guard):
        arr = scan(content, pattern, {"k": 1}, guard=guard)
        return nz(F.transform(F.filter(arr, lambda x: ~noise(x["k"])),
                              lambda x: fact("request", rule, order, x["k"], x["line"])))

    return F.concat(bound(GIN_BIND, "go_bind_json", 1, "BindJSON"),
                    bound(DECODE, "go_decode", 2, ".Decode"),
                    simple(QUERY, "go_query", 3, ".Query"),
                    simple(QUERY_GET, "go_query_get", 4, ".Query()"),
                    simple(POST_FORM, "go_post_form", 5, ".PostForm"),
                    simple(FORM_VALUE, "go_form_value", 6, ".FormValue"))
