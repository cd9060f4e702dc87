"""Route (backend) and call (frontend) detection, E1-E10.

Every file runs through both detectors whatever its language. Output is one
array column per file, exploded once by the caller:
array<struct<role, rule, method, url>> with ``url`` already normalised.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deadwire.functions.calls import calls
from deadwire.functions.scalars import method_from_options, normalize_url
from deadwire.functions.text import let, pick

# --- fixed values: detector patterns -----------------------------------------
EXPRESS = r"(?:app|router)\.(get|post|put|delete|patch)\(['\"`](.*?)['\"`]"
FLASK = r"@app\.route\(['\"`](.*?)['\"`]"
SPRING = r"@(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\(['\"`](.*?)['\"`]"
GIN = r"(?:\w+)\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\(\s*\"([^\"]+)\""
GORILLA = (r"\.Handle(?:Func)?\(\s*\"([^\"]+)\"[^)]*\)"
           r"(?:[^.]*\.Methods\(\s*(?:\"([A-Z]+)\"|http\.Method([A-Za-z]+))\))?")
NET_HTTP = r"\bhttp\.Handle(?:Func)?\(\s*\"([^\"]+)\""
AXIOS = r"axios\.(get|post|put|delete|patch)\(['\"`](.*?)['\"`]"
HELPER_CALL = r"^\$\{this\.([a-zA-Z]+)\([^)]*\)\}(.*)\z"

# --- fixed values: route helpers of the client library (helper -> base) -------
ROUTE_HELPERS = {
    "getBaseRoute": "/api/v4",
    "getUsersRoute": "/api/v4/users",
    "getUserRoute": "/api/v4/users/:param",
    "getTeamsRoute": "/api/v4/teams",
    "getTeamRoute": "/api/v4/teams/:param",
    "getTeamMembersRoute": "/api/v4/teams/:param/members",
    "getTeamMemberRoute": "/api/v4/teams/:param/members/:param",
    "getTeamSchemeRoute": "/api/v4/teams/:param/scheme",
    "getChannelsRoute": "/api/v4/channels",
    "getChannelRoute": "/api/v4/channels/:param",
    "getChannelMembersRoute": "/api/v4/channels/:param/members",
    "getChannelMemberRoute": "/api/v4/channels/:param/members/:param",
    "getChannelSchemeRoute": "/api/v4/channels/:param/scheme",
    "getPostsRoute": "/api/v4/posts",
    "getPostRoute": "/api/v4/posts/:param",
    "getFilesRoute": "/api/v4/files",
    "getFileRoute": "/api/v4/files/:param",
    "getCommandsRoute": "/api/v4/commands",
    "getPreferencesRoute": "/api/v4/users/:param/preferences",
    "getReactionsRoute": "/api/v4/reactions",
}


def _all(content: Column, pattern: str, *idx: int) -> Column:
    """Capture groups of every match, zipped: array<struct<g1, g2, ..>>."""
    return F.arrays_zip(*[F.regexp_extract_all(content, F.lit(pattern), i).alias(f"g{i}")
                          for i in idx])


def _rows(role: str, rule: str, zipped: Column, method_of, url_of) -> Column:
    """Map zipped capture structs to route structs; drop null urls."""
    arr = F.transform(zipped, lambda z: F.struct(
        F.lit(role).alias("role"), F.lit(rule).alias("rule"),
        method_of(z).alias("method"), url_of(z).alias("url")))
    return F.filter(arr, lambda r: r["url"].isNotNull())


def _jstrim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def backend_routes(content: Column, found: Column | None = None) -> Column:
    """E1-E7, deduplicated by (method, url) within the file (first kept). ``found``: ``calls(content)``."""
    found = calls(content) if found is None else found
    parts = [
        _rows("backend", "express", _all(content, EXPRESS, 1, 2),
              lambda z: F.upper(z["g1"]), lambda z: normalize_url(z["g2"])),
        _rows("backend", "chained", pick(found, "chained"),
              lambda z: F.upper(z["rest"]), lambda z: normalize_url(z["url"])),
        _rows("backend", "flask", _all(content, FLASK, 1),
              lambda z: F.lit("GET"), lambda z: normalize_url(z["g1"])),
        _rows("backend", "spring", _all(content, SPRING, 1, 2),
              lambda z: F.upper(F.regexp_replace(z["g1"], "Mapping", "")),
              lambda z: normalize_url(z["g2"])),
        _rows("backend", "gin", _all(content, GIN, 1, 2),
              lambda z: F.upper(z["g1"]), lambda z: normalize_url(z["g2"])),
        _rows("backend", "gorilla", _all(content, GORILLA, 1, 2, 3),
              lambda z: F.coalesce(F.nullif(z["g2"], F.lit("")),
                                   F.nullif(F.upper(z["g3"]), F.lit("")), F.lit("GET")),
              lambda z: normalize_url(z["g1"])),
        _rows("backend", "net_http", _all(content, NET_HTTP, 1),
              lambda z: F.lit("GET"), lambda z: normalize_url(z["g1"])),
    ]
    # first (method, url) per file wins: sort by key then position, keep the
    # first of each key, restore file order (r log r)
    keyed = F.transform(F.concat(*parts), lambda r, i: F.struct(
        r["method"].alias("m"), r["url"].alias("u"), i.alias("i"), r.alias("r")))
    kept = let(F.array_sort(keyed), lambda srt: F.filter(srt, lambda x, i: (i == 0) | ~(
        (F.element_at(srt, F.greatest(i, F.lit(1)))["m"] == x["m"])
        & (F.element_at(srt, F.greatest(i, F.lit(1)))["u"] == x["u"]))))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r"))))
    return F.transform(ordered, lambda x: x["r"])


def _helper_map() -> Column:
    kv = []
    for k, v in ROUTE_HELPERS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def frontend_calls(content: Column, found: Column | None = None) -> Column:
    """E8-E10 (no dedup: the registry keeps each file once per endpoint). ``found``: ``calls(content)``."""
    found = calls(content) if found is None else found
    parts = [
        _rows("frontend", "fetch", pick(found, "fetch"),
              lambda z: F.when(z["rest"] == "", F.lit("GET")).otherwise(method_from_options(z["rest"])),
              lambda z: normalize_url(z["url"])),
        _rows("frontend", "axios", _all(content, AXIOS, 1, 2),
              lambda z: F.upper(z["g1"]), lambda z: normalize_url(z["g2"])),
    ]
    helpers = _helper_map()

    def url_of(z):
        expr = _jstrim(z["url"])
        plain = F.regexp_extract(expr, r"^['\"]([^'\"]+)['\"]$", 1)
        tmpl_ok = expr.rlike(r"^`[\s\S]*?`$")
        tmpl = F.regexp_extract(expr, r"^`([\s\S]*?)`$", 1)
        helper = F.regexp_extract(tmpl, HELPER_CALL, 1)
        suffix = _jstrim(F.regexp_extract(tmpl, HELPER_CALL, 2))
        base = F.element_at(helpers, helper)
        return (F.when(plain != "", normalize_url(plain))
                .when(tmpl_ok & tmpl.rlike(HELPER_CALL) & base.isNotNull(),
                      normalize_url(F.concat(base, suffix))))

    parts.append(_rows("frontend", "do_fetch", pick(found, "do_fetch"),
                       lambda z: method_from_options(z["rest"]), url_of))
    return F.concat(*parts)


def route_facts(content: Column, found: Column) -> Column:
    """All routes and calls of one file; ``found``: ``calls(content)``."""
    return F.concat(backend_routes(content, found), frontend_calls(content, found))
