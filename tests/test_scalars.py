"""Scoring, units and identifier helpers (same cases as the analysed tool's
unit tests, plus order traps of our own)."""
import pytest
from pyspark.sql import functions as F

from deadwire.functions import scalars as S


def one(spark, col, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(col(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("names,expected", [
    (["isActive", "hasPermission"], 5),
    (["userId", "recordUuid"], 38),
    (["createdAt", "updatedAt"], 26),
    (["email", "userEmail"], 27),
    (["avatarUrl", "profileLink"], 52),
    (["accessToken", "passwordHash"], 66),
    # order traps
    (["deletedAt", "issue"], 5),
    (["paid"], 38),
    (["format"], 26),
    (["country"], 6),
    (["displayName"], 22),
    (["description"], 80),
    (["metadata"], 64),
    (["tags", "items"], 40),
    (["zzz"], 22),
])
def test_field_bytes(spark, names, expected):
    for n in names:
        assert one(spark, S.estimate_field_bytes, n) == expected, n


@pytest.mark.parametrize("pattern,expected", [
    ("GET /health", 100_000), ("GET /ping", 100_000), ("GET /api/status/", 100_000),
    ("POST /api/login", 50_000), ("GET /api/users", 10_000), ("GET /admin/users", 500),
    ("POST /api/webhooks/x", 1_000), ("POST /api/orders", 5_000), ("GET /api/orders", 10_000),
    ("GET /api/products", 10_000), ("", 10_000), (None, 10_000),
    ("post /api/orders", 10_000),  # write tier is case-sensitive
])
def test_daily_requests(spark, pattern, expected):
    assert one(spark, S.estimate_daily_requests, pattern) == expected


def test_tier_order(spark):
    login = one(spark, S.estimate_daily_requests, "POST /api/login")
    users = one(spark, S.estimate_daily_requests, "GET /api/users")
    admin = one(spark, S.estimate_daily_requests, "GET /admin/users")
    assert login > users > admin
    assert one(spark, S.estimate_daily_requests, "POST /api/orders") < users


def test_score_and_energy(spark):
    df = spark.createDataFrame([("userId", "GET /api/users")], "n string, p string")
    r = df.select(S.score_waste(F.col("n"), F.col("p")).alias("w"),
                  S.score_waste(F.col("n")).alias("w0"),
                  S.estimate_co2_kwh(F.lit(1_000_000_000)).alias("kwh")).first()
    assert r.w == 38 * 10_000 and r.w0 == 38 * 10_000
    assert r.kwh == 0.06


@pytest.mark.parametrize("raw,norm", [
    ("/api/users/${id}", "/api/users/:param"),
    ("/api/users/:userId/posts/:postId", "/api/users/:param/posts/:param"),
    ("/api/users/<int:user_id>", "/api/users/:param"),
    ("/users/{id}", "/users/:param"),
    ("http://localhost:8080/api", "http://localhost:8080/api"),
])
def test_normalize_url(spark, raw, norm):
    assert one(spark, S.normalize_url, raw) == norm


@pytest.mark.parametrize("n,words", [
    (999, "999 bytes"), (1_500, "1 thousand bytes"), (2_000_000, "2 million bytes"),
    (2_030_000, "2 million 30 thousand bytes"), (3_000_004_000, "3 billion 4 thousand bytes"),
])
def test_number_to_words(spark, n, words):
    assert one(spark, S.number_to_words, n, "bigint") == words


def test_identifier_helpers(spark):
    assert one(spark, S.getter_to_field_name, "getFirstName") == "firstName"
    assert one(spark, S.getter_to_field_name, "FirstName") == "firstName"
    assert one(spark, S.strip_generics, "List<UserDto>") == "List"
    assert one(spark, S.snake_to_getter, "first_name") == "getFirstName"
    assert one(spark, S.express_to_python_url, "/api/users/:id") == "/api/users/{id}"
    df = spark.createDataFrame([("Owner", None), ("Extra", ",omitempty"), ("X", "-"), ("Y", "why,omitempty")],
                               "g string, t string")
    got = [r.j for r in df.select(S.json_tag_name(F.col("g"), F.col("t")).alias("j")).collect()]
    assert got == ["owner", "extra", None, "why"]


def test_units_and_messages(spark):
    df = spark.createDataFrame([("a/b\\c.ts", 1234567, "email", "response", 5)],
                               "p string, w bigint, n string, s string, l int")
    r = df.select(S.base_name(F.col("p")).alias("b"), S.to_kb(F.col("w")).alias("kb"),
                  S.carbon_grams(F.col("w")).alias("g"),
                  S.finding_message(F.col("n"), F.col("s"), F.col("w")).alias("m"),
                  S.parse_location(S.defined_at(F.lit("src/x.ts"), F.col("l"))).alias("loc")).first()
    assert r.b == "c.ts" and r.kb == 1234.6 and r.g == round(1234567 * 6.916e-8, 6)
    assert r.m == "'email' is defined but never accessed by the frontend. Estimated waste: ~1,234,567.00 bytes/day"
    assert r.loc.path == "src/x.ts" and r.loc.line0 == 4
