"""Python rules: response/request definitions (E18, E19) and request reads
(E20, E21). Each function maps the file's ``content`` column to
array<struct<side, rule, ord, name, line>>; ``ord`` orders rules for
first-wins deduplication."""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

from deadwire.functions.noise import is_noise
from deadwire.functions.text import match_lines, nl, pick, scan

IDENT = r"[a-zA-Z_][a-zA-Z0-9_]*"
# --- fixed values: Python rule patterns ---------------------------------------
JSONIFY = r"jsonify\s*\(\s*\{"
RETURN_DICT = r"\breturn\s*\{"
JSON_RESPONSE = r"JSONResponse\s*\(\s*content\s*=\s*\{"
DICT_KEY = r"[\"'](" + IDENT + r")[\"']\s*:"
# Model body runs to the next top-level class or the end of the file.
MODEL = r"class\s+\w+\s*\(\s*BaseModel\s*\)\s*:([\s\S]*?)(?=\nclass |\z)"
MODEL_FIELD = r"(?m)^\s{4}(" + IDENT + r")\s*:"
ROUTE_DECORATOR = r"@(?:\w+\.)?(?:route|get|post|put|delete|patch|head|options)\s*\("
DEF_HEAD = r"\bdef\s+\w+\s*\([^)]*\)\s*:"
JSON_GET = r"request\.json\.get\(\s*['\"](" + IDENT + r")['\"]\)"
JSON_INDEX = r"request\.json\[['\"](" + IDENT + r")['\"]\]"
JSON_ALIAS = r"([a-zA-Z_]\w*)\s*=\s*request\.json"
FORM_GET = r"request\.form\.get\(\s*['\"](" + IDENT + r")['\"]\)"
ARGS_GET = r"request\.args\.get\(\s*['\"](" + IDENT + r")['\"]\)"
MODEL_PARAM = r"def\s+\w+\s*\([^)]*\b(\w+)\s*:\s*([A-Z]\w*)[^)]*\)"

_DECORATOR = re.compile(ROUTE_DECORATOR, re.ASCII)
_HEAD = re.compile("(?=(" + DEF_HEAD + "))", re.ASCII)  # heads inside one another too
_SPACE = " \t\n\x0b\f\r"

FACT = "struct<side:string,rule:string,ord:int,name:string,line:int>"


def fact(side: str, rule: str, order: int, name: Column, line: Column) -> Column:
    return F.struct(F.lit(side).alias("side"), F.lit(rule).alias("rule"),
                    F.lit(order).alias("ord"), name.alias("name"), line.cast("int").alias("line"))


def empty() -> Column:
    return F.array().cast("array<" + FACT + ">")


def nz(arr: Column) -> Column:
    return F.coalesce(arr, empty())


def keys_in_bodies(bodies: Column, key_re: str, side: str, rule: str, order: int,
                   noise) -> Column:
    """Quoted keys at any depth of each opener body, with absolute lines."""
    def per_body(o):
        ks = scan(o["body"], key_re, {"k": 1})
        ks = F.filter(ks, lambda k: ~noise(k["k"]))
        return F.transform(ks, lambda k: fact(side, rule, order, k["k"],
                                              o["line"] + nl(o["m"]) + k["line"] - 1))
    return F.flatten(F.transform(bodies, per_body))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(_SPACE))


def route_spans(text: str) -> list[tuple[int, int]]:
    """Line spans [first, end) of the route-decorated function bodies of a file, merged and in order.

    A body belongs to the first ``def ...:`` after a decorator and ends at the first later line that is indented less
    than its first statement. One pass from the last line up keeps, for every line, the lines below it that
    could end a body (their indents fall), so each decorator costs a binary search."""
    marks = list(_DECORATOR.finditer(text))
    if not marks:
        return []
    heads = [(m.start(), m.start() + len(m[1])) for m in _HEAD.finditer(text)]
    starts = [h[0] for h in heads]
    lines = text.split("\n")
    breaks = [m.start() for m in re.finditer("\n", text)]
    asked: dict[int, list[str]] = {}  # line of a head's end (from 1) -> what follows the head on it
    for m in marks:
        i = bisect_left(starts, m.end())
        if i < len(heads):
            line = bisect_left(breaks, heads[i][1])
            after = text[heads[i][1]:breaks[line] if line < len(breaks) else len(text)]
            asked.setdefault(line + 1, []).append(after)
    spans, below = [], []  # below: (indent, line) of lines that may end a body, the nearest last
    for line in range(len(lines), 0, -1):
        for after in asked.get(line, ()):
            # the nearest written line below is the last one of ``below``
            need = _indent(after) if after.strip(_SPACE) else below[-1][0] if below else -1
            k = bisect_left(below, (need, 0))
            spans.append((line, below[k - 1][1] if k else len(lines) + 1))
        if lines[line - 1].strip(_SPACE):
            here = _indent(lines[line - 1])
            while below and below[-1][0] >= here:
                below.pop()
            below.append((here, line))
    merged: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((first, end))
    return merged


def in_routes(text: str, lines: list[int]) -> list[bool]:
    """For each line number: whether it stands in a route function's body."""
    spans = route_spans(text)
    firsts = [s for s, _ in spans]
    at = [bisect_right(firsts, line) - 1 for line in lines]
    return [i >= 0 and line < spans[i][1] for i, line in zip(at, lines)]


BODY_RULES = {"jsonify": (JSONIFY, "jsonify"), "return": (RETURN_DICT, "return"),
              "JSONResponse": (JSON_RESPONSE, "JSONResponse")}
#: Rules whose matches count only where a test of (text, their lines) says so.
BODY_TESTS = {"return": in_routes}


def py_defs(content: Column, found: Column) -> Column:
    """Response dict keys (jsonify / return in a route function /
    JSONResponse) and request-model fields (BaseModel classes)."""
    noise = lambda n: is_noise(n, "py", "def")
    a = pick(found, "jsonify")
    b = pick(found, "return")  # those in route functions
    c = pick(found, "JSONResponse")
    out_a = keys_in_bodies(a, DICT_KEY, "response", "py_jsonify", 1, noise)
    out_b = keys_in_bodies(b, DICT_KEY, "response", "py_return_dict", 2, noise)
    out_c = keys_in_bodies(c, DICT_KEY, "response", "py_json_response", 3, noise)
    models = scan(content, MODEL, {"body": 1}, guard="BaseModel")

    def model_fields(mo):
        head_nl = nl(mo["m"]) - nl(mo["body"])
        fs = F.filter(scan(mo["body"], MODEL_FIELD, {"k": 1}), lambda k: ~noise(k["k"]))
        return F.transform(fs, lambda k: fact("request", "py_model", 4, k["k"],
                                              mo["line"] + head_nl + k["line"] - 1))
    out_d = F.flatten(F.transform(models, model_fields))
    return F.concat(nz(out_a), nz(out_b), nz(out_c), nz(out_d))


def _model_field_names(content: Column, model: Column) -> Column:
    pat = F.concat(F.lit(r"class\s+"), model,
                   F.lit(r"\s*\(\s*BaseModel\s*\)\s*:([\s\S]*?)(?=\nclass |\z)"))
    bodies = F.regexp_extract_all(content, pat, 1)
    names = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(MODEL_FIELD), 1)))
    return F.filter(names, lambda x: ~is_noise(x, "py", "read"))


def py_reads(content: Column) -> Column:
    """Request reads: request.json/.form/.args, aliases of request.json and
    parameters typed with an in-file BaseModel."""
    noise = lambda n: is_noise(n, "py", "read")

    def simple(pattern, rule, order, guard):
        arr = scan(content, pattern, {"k": 1}, guard=guard)
        return nz(F.transform(F.filter(arr, lambda x: ~noise(x["k"])),
                              lambda x: fact("request", rule, order, x["k"], x["line"])))

    a1 = simple(JSON_GET, "py_json_get", 1, "request.json")
    a2 = simple(JSON_INDEX, "py_json_index", 2, "request.json")
    aliases = F.regexp_extract_all(content, F.lit(JSON_ALIAS), 1)

    def via_alias(v):
        get_pat = F.concat(v, F.lit(r"\.get\(\s*['\"](" + IDENT + r")['\"]\)"))
        idx_pat = F.concat(v, F.lit(r"\[['\"](" + IDENT + r")['\"]\]"))
        g = F.arrays_zip(match_lines(content, get_pat).alias("line"),
                         F.regexp_extract_all(content, get_pat, 1).alias("k"))
        i = F.arrays_zip(match_lines(content, idx_pat).alias("line"),
                         F.regexp_extract_all(content, idx_pat, 1).alias("k"))
        return F.concat(
            F.transform(F.filter(g, lambda x: ~noise(x["k"])),
                        lambda x: fact("request", "py_alias_get", 3, x["k"], x["line"])),
            F.transform(F.filter(i, lambda x: ~noise(x["k"])),
                        lambda x: fact("request", "py_alias_index", 4, x["k"], x["line"])))

    b = F.when(content.contains("request.json"), F.flatten(F.transform(aliases, via_alias)))
    c = simple(FORM_GET, "py_form_get", 5, "request.form")
    d = simple(ARGS_GET, "py_args_get", 6, "request.args")

    sigs = scan(content, MODEL_PARAM, {"param": 1, "model": 2}, guard="BaseModel")

    def via_model(s):
        fields = _model_field_names(content, s["model"])
        acc_pat = F.concat(s["param"], F.lit(r"\.(" + IDENT + r")"))
        acc = F.filter(F.regexp_extract_all(content, acc_pat, 1), lambda x: ~noise(x))
        chosen = F.when(F.size(acc) > 0, acc).otherwise(fields)
        chosen = F.when(F.size(fields) > 0, chosen).otherwise(F.array().cast("array<string>"))
        return F.transform(chosen, lambda x: fact("request", "py_model_param", 7, x, s["line"]))

    e = F.flatten(F.transform(sigs, via_model))
    return F.concat(a1, a2, nz(b), c, d, nz(e))
