"""Java (Spring) rules: response definitions (E22, J5) and request reads
(E23, E24)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deadwire.functions.noise import is_noise
from deadwire.functions.scalars import getter_to_field_name, strip_generics
from deadwire.functions.text import let, match_lines, nl, pick, scan
from deadwire.operators.rules_py import fact, nz

IDENT = r"[a-zA-Z_][a-zA-Z0-9_]*"
# --- fixed values: Java rule patterns -----------------------------------------
REQUEST_BODY_TYPE = r"@RequestBody\s+(\w+(?:<[^>]+>)?)\s+\w+"
CLASS_HEAD = r"class\s+(\w+)\s*(?:extends\s+\w+\s*)?(?:implements[^{]+)?\{"
ANNOTATION = r"@\w+(?:\([^)]*\))?\s*"
FIELD_DECL = (r"(?:private|public|protected)\s+(?:final\s+)?[\w<>\[\],\s]+\s+"
              r"([a-z][a-zA-Z0-9_]*)\s*[;=]")
# A whole run of annotations is taken at once (possessive: no recursion per annotation, no second look at it) with
# the field that follows, if one does: group 1 the annotations, group 2 or 3 the field's name, '' if there is none.
FIELD = rf"((?:{ANNOTATION})++)(?:{FIELD_DECL})?|{FIELD_DECL}"
JSON_PROPERTY = r"@JsonProperty\(\s*[\"'](" + IDENT + r")[\"']\)"
MAP_OF = r"Map\.of\(([^)]+)\)"
MAP_KEY = r"^\"(" + IDENT + r")\"$"
PUT = r"\.put\(\s*[\"'](" + IDENT + r")[\"']\s*,"
REQUEST_BODY_PARAM = r"@RequestBody\s+(\w+(?:<[^>]+>)?)\s+(\w+)"
PARAM_NAMED = r"@RequestParam\(\s*(?:value\s*=\s*)?[\"'](" + IDENT + r")[\"']\)"
PARAM_TYPED = r"@RequestParam\s+\w[\w<>\[\],\s]*\s+([a-z]\w*)"
GET_PARAMETER = r"request\.getParameter\(\s*[\"'](" + IDENT + r")[\"']\)"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


BODY_RULES = {"class": (CLASS_HEAD, "class")}


def java_defs(content: Column, found: Column) -> Column:
    """DTO fields of classes not bound by @RequestBody, Map.of keys, .put keys."""
    noise = lambda n: is_noise(n, "java", "def")
    bound = F.transform(F.regexp_extract_all(content, F.lit(REQUEST_BODY_TYPE), 1), strip_generics)
    classes = let(bound, lambda bd: F.filter(
        pick(found, "class"), lambda c: ~F.array_contains(bd, c["g"])))

    def fields_of(c):
        fs = F.transform(scan(c["body"], FIELD, {"after": 2, "bare": 3}), lambda f: F.struct(
            f["line"].alias("line"), f["m"].alias("m"), F.concat(f["after"], f["bare"]).alias("k")))
        fs = F.filter(fs, lambda f: (f["k"] != "") & ~noise(f["k"]))
        return F.transform(fs, lambda f: fact(
            "response", "java_dto", 1,
            F.coalesce(F.nullif(F.regexp_extract(f["m"], JSON_PROPERTY, 1), F.lit("")), f["k"]),
            c["line"] + nl(c["m"]) + f["line"] - 1))

    a = F.flatten(F.transform(classes, fields_of))
    maps = scan(content, MAP_OF, {"inner": 1}, guard="Map.of")

    def keys_of(mo):
        toks = F.transform(F.split(mo["inner"], ","), _trim)
        even = F.filter(toks, lambda t, i: (i % 2 == 0) & t.rlike(MAP_KEY))
        even = F.filter(even, lambda t: ~noise(F.regexp_extract(t, MAP_KEY, 1)))
        return F.transform(even, lambda t: fact(
            "response", "java_map_of", 2, F.regexp_extract(t, MAP_KEY, 1),
            mo["line"] + nl(F.call_function("substring_index", mo["m"], t, F.lit(1)))))

    b = F.flatten(F.transform(maps, keys_of))
    puts = scan(content, PUT, {"k": 1}, guard=".put(")
    c = F.transform(F.filter(puts, lambda p: ~noise(p["k"])),
                    lambda p: fact("response", "java_put", 3, p["k"], p["line"]))
    return F.concat(nz(a), nz(b), nz(c))


def nz_names(names: Column) -> Column:
    return F.coalesce(names, F.array().cast("array<string>"))


def _dto_field_names(found: Column, type_name: Column) -> Column:
    """Field names (with @JsonProperty override) of in-file classes named
    ``type_name``."""
    bodies = F.transform(F.filter(pick(found, "class"), lambda c: c["g"] == type_name), lambda c: c["body"])
    fre = F.lit(FIELD)

    def names(b):
        ann = F.regexp_extract_all(b, fre, 1)
        named = F.arrays_zip(ann.alias("a"), F.regexp_extract_all(b, fre, 2).alias("after"),
                             F.regexp_extract_all(b, fre, 3).alias("bare"))
        pairs = F.filter(F.transform(named, lambda p: F.struct(p["a"].alias("a"), F.concat(p["after"], p["bare"]).alias("n"))),
                         lambda p: (p["n"] != "") & ~is_noise(p["n"], "java", "read"))
        return F.transform(pairs, lambda p: F.coalesce(
            F.nullif(F.regexp_extract(p["a"], JSON_PROPERTY, 1), F.lit("")), p["n"]))

    return F.flatten(F.transform(bodies, names))


def java_reads(content: Column, found: Column) -> Column:
    """@RequestBody getters / direct fields (else all in-file DTO fields),
    @RequestParam names and request.getParameter."""
    noise = lambda n: is_noise(n, "java", "read")
    params = scan(content, REQUEST_BODY_PARAM, {"t": 1, "p": 2}, guard="@RequestBody")

    def per_param(p):
        gpat = F.concat(p["p"], F.lit(r"\.get([A-Z]\w*)\(\)"))
        dpat = F.concat(p["p"], F.lit(r"\.([a-z]\w*)\b(?!\()"))
        g = F.arrays_zip(match_lines(content, gpat).alias("line"),
                         F.transform(F.regexp_extract_all(content, gpat, 1),
                                     getter_to_field_name).alias("k"))
        g = F.filter(g, lambda x: (x["k"] != "") & ~noise(x["k"]))
        d = F.arrays_zip(match_lines(content, dpat).alias("line"),
                         F.regexp_extract_all(content, dpat, 1).alias("k"))
        d = F.filter(d, lambda x: ~noise(x["k"]))
        explicit = F.concat(
            F.transform(g, lambda x: fact("request", "java_getter", 1, x["k"], x["line"])),
            F.transform(d, lambda x: fact("request", "java_direct", 2, x["k"], x["line"])))
        fallback = F.transform(nz_names(_dto_field_names(found, strip_generics(p["t"]))),
                               lambda k: fact("request", "java_dto_all", 3, k, p["line"]))
        return F.when(F.size(g) + F.size(d) > 0, explicit).otherwise(fallback)

    a = F.flatten(F.transform(params, per_param))

    def simple(pattern, rule, order, guard):
        arr = scan(content, pattern, {"k": 1}, guard=guard)
        return nz(F.transform(F.filter(arr, lambda x: ~noise(x["k"])),
                              lambda x: fact("request", rule, order, x["k"], x["line"])))

    b1 = simple(PARAM_NAMED, "java_param_named", 4, "@RequestParam")
    b2 = simple(PARAM_TYPED, "java_param_typed", 5, "@RequestParam")
    c = simple(GET_PARAMETER, "java_get_parameter", 6, "getParameter")
    return F.concat(nz(a), b1, b2, c)
