"""Scalar column functions (URL normalisation, scoring, units, messages).

All are compositions of built-in Spark functions, so they run inside
whole-stage codegen. Names follow the public API of the analysis:
``estimate_field_bytes``, ``estimate_daily_requests``, ``score_waste``,
``estimate_co2_kwh`` and friends.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. These must equal the analysed tool's constants for results to
# agree; they are stated here once, in their natural order.
# ---------------------------------------------------------------------------
KWH_PER_BYTE = 6e-11            # fixed-line network energy, kWh per byte
CO2_GRAMS_PER_BYTE = 6.916e-8   # grams CO2e per byte shown in the dashboard

# Byte tiers by field name, checked in this order; first hit wins.
BOOL_PREFIXES = ("is", "has", "can", "should", "was", "did", "enabled", "active", "visible", "deleted",
                 "verified", "confirmed", "success", "failed", "done")
BOOL_SUFFIXES = ("enabled", "active", "visible")
ID_SUFFIXES = ("id", "uuid", "guid")
COUNT_PREFIXES = ("count", "total", "num", "number", "age", "score", "size", "length", "limit", "offset",
                  "page", "rank", "index", "version", "code", "status")
TIME_PREFIXES = ("created", "updated", "deleted", "modified", "published", "expires", "started", "ended",
                 "timestamp", "date", "time")
TIME_SUFFIXES = ("at", "date", "time", "timestamp")
EMAIL_PARTS = ("email", "mail")
URL_PARTS = ("url", "uri", "link", "href", "path")
TOKEN_PARTS = ("token", "hash", "secret", "key", "signature")
NAME_PARTS = ("name", "title", "label", "slug")
TEXT_PARTS = ("message", "description", "content", "body", "text", "bio")
OBJECT_PARTS = ("data", "meta", "info", "config", "settings", "options")
LIST_PARTS = ("list", "items", "array", "tags", "roles")
BYTES = {"bool": 5, "id": 38, "count": 6, "time": 26, "email": 27, "url": 52,
         "token": 66, "name": 22, "text": 80, "object": 64, "list": 40, "default": 22}

# Daily request tiers by endpoint pattern, checked in this order.
HEALTH_SEGMENTS = ("health", "ping", "status", "ready", "live")
AUTH_SEGMENTS = ("auth", "login", "logout", "signin", "signout", "session", "token", "refresh")
ADMIN_SEGMENTS = ("admin", "internal", "debug", "metrics", "_")
WRITE_VERBS = ("POST", "PUT", "PATCH", "DELETE")
REQUESTS = {"default": 10_000, "health": 100_000, "auth": 50_000, "admin": 500,
            "webhook": 1_000, "write": 5_000}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _alt(words: tuple[str, ...]) -> str:
    return "|".join(words)


# --- P1 / P2 / P4: URLs and patterns -----------------------------------------

def normalize_url(path) -> Column:
    """Template, express, flask and spring parameters all become ':param'."""
    p = _c(path)
    p = F.regexp_replace(p, r"\$\{[^}]+\}", ":param")
    p = F.regexp_replace(p, r":[A-Za-z_][A-Za-z0-9_]*", ":param")
    p = F.regexp_replace(p, r"<[^>]+>", ":param")
    p = F.regexp_replace(p, r"\{[^}]+\}", ":param")
    return p


def method_from_options(options) -> Column:
    """First ``method: '<word>'`` in a fetch options text, upper-cased; GET."""
    m = F.regexp_extract(_c(options), r"\bmethod\s*:\s*['\"`](\w+)['\"`]", 1)
    return F.coalesce(F.nullif(F.upper(m), F.lit("")), F.lit("GET"))


def pattern_key(method, path) -> Column:
    return F.concat_ws(" ", _c(method), _c(path))


def pattern_method(pattern) -> Column:
    return F.split_part(_c(pattern), F.lit(" "), F.lit(1))


# --- P14 / P15 / P16 / P17: scoring -------------------------------------------

def _starts(n: Column, words: tuple[str, ...]) -> Column:
    return n.rlike("^(" + _alt(words) + ")")


def _ends(n: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | n.endswith(w)
    return out


def _has(n: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | n.contains(w)
    return out


def field_bytes_tier(name) -> Column:
    """Tier label of a field name (order is load-bearing)."""
    n = F.lower(_c(name))
    return (F.when(_starts(n, BOOL_PREFIXES) | _ends(n, BOOL_SUFFIXES), "bool")
            .when((n == "id") | _ends(n, ID_SUFFIXES) | n.rlike("[_-]id$"), "id")
            .when(_starts(n, COUNT_PREFIXES) | n.endswith("count"), "count")
            .when(_starts(n, TIME_PREFIXES) | _ends(n, TIME_SUFFIXES), "time")
            .when(_has(n, EMAIL_PARTS), "email")
            .when(_has(n, URL_PARTS), "url")
            .when(_has(n, TOKEN_PARTS), "token")
            .when(_has(n, NAME_PARTS), "name")
            .when(_has(n, TEXT_PARTS), "text")
            .when(_has(n, OBJECT_PARTS), "object")
            .when(_has(n, LIST_PARTS) | n.endswith("s"), "list")
            .otherwise("default"))


def tier_bytes(tier) -> Column:
    """Bytes of a tier label (a literal map lookup)."""
    m = F.create_map(*[x for k, v in BYTES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, _c(tier)).cast("int")


def estimate_field_bytes(name) -> Column:
    """Estimated serialized JSON bytes of a field's value, from its name."""
    return tier_bytes(field_bytes_tier(name))


def estimate_daily_requests(pattern) -> Column:
    """Estimated daily requests of an endpoint from its ``METHOD path`` key.
    Segment tiers look at the lower-cased key, the write-verb tier at the
    original one; null or empty is the default tier."""
    p0 = _c(pattern)
    p = F.lower(p0)
    seg = lambda words: p.rlike("/(" + _alt(words) + ")(/|$)")
    return (F.when(p0.isNull() | (p0 == ""), F.lit(REQUESTS["default"]))
            .when(seg(HEALTH_SEGMENTS), F.lit(REQUESTS["health"]))
            .when(seg(AUTH_SEGMENTS), F.lit(REQUESTS["auth"]))
            .when(seg(ADMIN_SEGMENTS), F.lit(REQUESTS["admin"]))
            .when(p.rlike("/webhook"), F.lit(REQUESTS["webhook"]))
            .when(p0.rlike("^(" + _alt(WRITE_VERBS) + ")"), F.lit(REQUESTS["write"]))
            .otherwise(F.lit(REQUESTS["default"]))).cast("int")


def score_waste(name, pattern=None) -> Column:
    """Daily wasted bytes of a dead field: bytes x requests, exact BIGINT."""
    pat = F.lit(None).cast("string") if pattern is None else _c(pattern)
    return estimate_field_bytes(name).cast("bigint") * estimate_daily_requests(pat).cast("bigint")


def estimate_co2_kwh(bytes_per_day) -> Column:
    return _c(bytes_per_day).cast("double") * F.lit(KWH_PER_BYTE)


def estimate_wh(bytes_per_day) -> Column:
    return estimate_co2_kwh(bytes_per_day) * F.lit(1000.0)


def carbon_grams(bytes_per_day) -> Column:
    """Grams CO2e per day, 6 decimals."""
    return F.round(_c(bytes_per_day).cast("double") * F.lit(CO2_GRAMS_PER_BYTE), 6)


def to_kb(bytes_) -> Column:
    """Decimal kilobytes (/1000), one decimal."""
    return F.round(_c(bytes_).cast("double") / 1000.0, 1)


def number_to_words(num) -> Column:
    """'N billion M million K thousand bytes' with zero parts left out."""
    n = _c(num).cast("bigint")
    b = F.floor(n / 1_000_000_000)
    m = F.floor(F.pmod(n, F.lit(1_000_000_000)) / 1_000_000)
    k = F.floor(F.pmod(n, F.lit(1_000_000)) / 1_000)
    part = lambda v, w: F.when(v > 0, F.concat(v.cast("string"), F.lit(" " + w)))
    big = F.concat_ws(" ", F.concat(b.cast("string"), F.lit(" billion")), part(m, "million"),
                      part(k, "thousand"))
    mid = F.concat_ws(" ", F.concat(m.cast("string"), F.lit(" million")), part(k, "thousand"))
    return (F.when(n >= 1_000_000_000, F.concat(big, F.lit(" bytes")))
            .when(n >= 1_000_000, F.concat(mid, F.lit(" bytes")))
            .when(n >= 1_000, F.concat(k.cast("string"), F.lit(" thousand bytes")))
            .otherwise(F.concat(n.cast("string"), F.lit(" bytes"))))


# --- P21 / P22 / P7: messages and locations ------------------------------------

def finding_message(name, side, score) -> Column:
    reader = F.when(_c(side) == "response", F.lit("frontend")).otherwise(F.lit("backend"))
    return F.format_string(
        "'%s' is defined but never accessed by the %s. Estimated waste: ~%s bytes/day",
        _c(name), reader, F.format_number(_c(score).cast("double"), 2))


def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), r"[\\/]"), -1)


def defined_at(path, line) -> Column:
    return F.concat_ws(":", _c(path), _c(line).cast("string"))


def parse_location(defined_at_col) -> Column:
    """struct<path, line0>: split at the last ':'; 0-based line, never negative;
    null when malformed."""
    s = _c(defined_at_col)
    path = F.regexp_extract(s, r"^(.*):([0-9]+)$", 1)
    line = F.regexp_extract(s, r"^(.*):([0-9]+)$", 2)
    ok = s.rlike(r"^(.*):([0-9]+)$")
    return F.when(ok, F.struct(path.alias("path"),
                               F.greatest(line.cast("int") - 1, F.lit(0)).alias("line0")))


# --- P10 / P11 / P12 / P23: identifier helpers ---------------------------------

def lower_first(s) -> Column:
    s = _c(s)
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def getter_to_field_name(getter) -> Column:
    """'getFirstName' or 'FirstName' -> 'firstName'."""
    return lower_first(F.regexp_replace(_c(getter), "^get", ""))


def strip_generics(type_name) -> Column:
    """Remove the first '<...>' group: 'List<UserDto>' -> 'List'."""
    return F.trim(F.regexp_replace(_c(type_name), "^([^<]*)<[^>]+>", "$1"))


def json_tag_name(go_name, tag) -> Column:
    """Name a Go struct field serialises to; null when tagged '-'."""
    raw = F.trim(F.split_part(_c(tag), F.lit(","), F.lit(1)))
    fallback = lower_first(go_name)
    return (F.when(_c(tag).isNull(), fallback)
            .when(raw == "-", F.lit(None).cast("string"))
            .when(raw == "", fallback)
            .otherwise(raw))


def snake_to_getter(name) -> Column:
    """'first_name' -> 'getFirstName'."""
    parts = F.split(_c(name), "_")
    return F.concat(F.lit("get"), F.array_join(F.transform(
        parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), ""))


def express_to_python_url(path) -> Column:
    """':id' -> '{id}'."""
    return F.regexp_replace(_c(path), r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")


def express_to_template(path) -> Column:
    """':id' -> '${id}'."""
    return F.regexp_replace(_c(path), r":([A-Za-z_][A-Za-z0-9_]*)", "\\${id}")
