"""Extraction rules on our fixture files: presence, absence and line of every
name, per language and rule family (routes, definitions, reads)."""


def names(facts, file, ext):
    return {n for n, _ in facts.get((file, ext), set())}


# --- routes and calls ---------------------------------------------------------

def test_flask_routes_are_get(routes):
    got = {(m, u) for f, role, m, u in routes if f == "flask_app.py"}
    assert got == {("GET", "/api/accounts"), ("GET", "/api/accounts/:param"),
                   ("GET", "/api/signup"), ("GET", "/api/search")}


def test_fastapi_and_spring_routes(routes):
    assert {(m, u) for f, _, m, u in routes if f == "fastapi_app.py"} == {
        ("GET", "/api/ping"), ("POST", "/api/signup"), ("POST", "/api/profile")}
    # class-level @RequestMapping prefix is not applied
    assert {(m, u) for f, _, m, u in routes if f == "AccountController.java"} == {
        ("POST", "/accounts"), ("PUT", "/accounts/:param"), ("GET", "/lookup")}


def test_go_routes(routes):
    assert {(m, u) for f, _, m, u in routes if f == "gin_api.go"} == {
        ("POST", "/api/login"), ("GET", "/api/items")}
    # net/http and gorilla forms; duplicates within a file collapse
    assert {(m, u) for f, _, m, u in routes if f == "http_api.go"} == {
        ("GET", "/health"), ("POST", "/api/login"), ("PUT", "/api/logout")}


def test_frontend_calls(routes):
    assert {(m, u) for f, r, m, u in routes if f == "send_axios.ts"} == {("POST", "/accounts")}
    assert {(m, u) for f, r, m, u in routes if f == "send_fetch.ts"} == {
        ("POST", "/api/orders"), ("PUT", "/api/drafts")}
    assert {(r, m, u) for f, r, m, u in routes if f.startswith("orders_")} == {
        ("frontend", "GET", "/api/orders"), ("frontend", "POST", "/api/orders"),
        ("backend", "GET", "/api/orders"), ("backend", "POST", "/api/orders")}


def test_do_fetch_helpers(spark):
    from pyspark.sql import functions as F
    from deadwire.operators.routes import frontend_calls
    src = """
    getUser = (id) => this.doFetch<User>(`${this.getUserRoute(id)}/status`, {method: 'get'});
    patchTeam = () => this.doFetchWithResponse(`${this.getTeamRoute(t)}/patch`, {method: 'put'});
    plain = () => this.doFetch('/api/v4/system/ping', {method: 'get'});
    unknown = () => this.doFetch(`${this.getNothingRoute()}/x`, {method: 'post'});
    """
    df = spark.createDataFrame([(src,)], "content string")
    got = {(r.method, r.url) for r in df.select(F.inline(frontend_calls(F.col("content")))).collect()}
    assert got == {("GET", "/api/v4/users/:param/status"), ("PUT", "/api/v4/teams/:param/patch"),
                   ("GET", "/api/v4/system/ping")}


# --- Python ----------------------------------------------------------------------

def test_python_response_defs(facts):
    got = facts[("flask_app.py", "py_defs")]
    assert got == {("accountId", 8), ("ownerEmail", 8), ("nickname", 8), ("balance", 14),
                   ("meta", 16), ("openedAt", 16), ("created", 25), ("results", 36)}
    # constants, dunders and dicts returned outside route functions are skipped
    assert not names(facts, "flask_app.py", "py_defs") & {"KEY_CONST", "__private", "hiddenKey"}


def test_python_models_and_json_response(facts):
    got = facts[("fastapi_app.py", "py_defs")]
    assert {("handle", 9), ("mail", 10), ("years", 11), ("profileId", 16), ("label", 17)} <= got
    assert {("alive", 22), ("build", 22), ("ok", 27), ("saved", 33)} <= got
    assert "model_config" not in names(facts, "fastapi_app.py", "py_defs")


def test_python_model_sides(fact_rows):
    sides = {(r.name, r.side) for r in fact_rows if r.path.endswith("fastapi_app.py") and r.ext == "py_defs"}
    assert ("handle", "request") in sides and ("alive", "response") in sides


def test_python_reads(facts):
    assert facts[("flask_app.py", "py_reads")] == {
        ("loginName", 23), ("passphrase", 24), ("term", 34), ("tag", 35)}
    # model parameter: explicit attribute reads win, else every model field
    assert facts[("fastapi_app.py", "py_reads")] == {
        ("handle", 26), ("mail", 26), ("years", 26), ("label", 31)}


# --- Java ----------------------------------------------------------------------------

def test_java_defs(facts):
    assert facts[("AccountDto.java", "java_defs")] == {
        ("displayTitle", 6), ("avatar_link", 7), ("followerCount", 9), ("badge", 13),
        ("tier", 14), ("score", 14)}
    # request-body DTOs are not response definitions
    assert ("AccountController.java", "java_defs") not in facts


def test_java_reads(facts):
    assert facts[("AccountController.java", "java_reads")] == {
        ("givenName", 11), ("familyName", 12), ("mailbox", 12),
        ("nickName", 16), ("zip_code", 16),          # opaque @RequestBody: all DTO fields
        ("name", 20),                                 # raw-text rule also matches the comment
        ("needle", 22), ("pageSize", 22), ("session_token", 23)}
    assert facts[("AccountDto.java", "java_reads")] == {("ignoredField", 23)}


# --- Go ----------------------------------------------------------------------------

def test_go_defs(facts):
    assert facts[("gin_api.go", "go_defs")] == {
        ("sessionId", 6), ("expiresIn", 7), ("owner", 9), ("extra", 10),
        ("granted", 26), ("items", 33), ("page", 33), ("kind", 33)}
    assert facts[("http_api.go", "go_defs")] == {("status", 15), ("version", 16), ("session", 25)}


def test_go_reads(facts):
    assert facts[("gin_api.go", "go_reads")] == {
        ("account", 21), ("password", 21), ("page", 31), ("kind", 32)}
    assert facts[("http_api.go", "go_reads")] == {
        ("user", 22), ("pin", 22), ("redirect", 23), ("remember", 24)}


# --- TypeScript --------------------------------------------------------------------

def test_ts_request_defs(facts):
    assert facts[("send_axios.ts", "ts_request_defs")] == {
        ("givenName", 5), ("familyName", 6), ("mailbox", 7), ("plan", 8)}
    assert facts[("send_fetch.ts", "ts_request_defs")] == {
        ("sku", 7), ("quantity", 8), ("giftWrap", 9), ("note", 10),
        ("draftId", 17), ("draftTitle", 18), ("previewOnly", 26)}
    assert "ghostField" not in names(facts, "send_fetch.ts", "ts_request_defs")


def test_ts_reads(facts):
    got = facts[("read_patterns.tsx", "ts_reads")]
    assert got == {("payload", 4), ("headline", 7), ("author", 8), ("handle", 8),
                   ("score", 9), ("stats", 9), ("views", 9), ("tags", 9), ("others", 9),
                   ("subtitle", 10), ("caption", 13), ("summary", 14), ("grandTotal", 14),
                   ("footer", 18), ("children", 18), ("rowId", 21), ("cells", 21)}
    n = names(facts, "read_patterns.tsx", "ts_reads")
    # comments, strings, aliases, dynamic keys, builtins and constants are not reads
    assert not n & {"commentedOut", "inString", "labels", "dynamicKey", "entries", "map",
                    "length", "MAX_SIZE"}


def test_ts_backend_response_defs(facts):
    # array literal responses are not handled; one chained call is unwrapped
    assert facts[("orders_server.ts", "ts_response_defs")] == {("accepted", 11), ("orderRef", 11)}
    assert facts[("orders_server.ts", "ts_reads")] == {("status", 11)}


def test_dedup_first_wins(spark):
    from pyspark.sql import functions as F
    from deadwire.operators.extract import extract, facts_of
    src = "res.json({ a1: 1 });\nres.send({ a1: 2, b2: 3 });\n"
    df = spark.createDataFrame([("r", "x.ts", "ts", src)], "repo string, path string, lang string, content string")
    got = {(r.name, r.line) for r in facts_of(extract(df)).filter(F.col("ext") == "ts_response_defs").collect()}
    assert got == {("a1", 1), ("b2", 2)}
