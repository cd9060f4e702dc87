"""Oracle SQL (DuckDB dialect) for every named query.

Corpus queries are answered from ``part`` and ``lineitem`` directly, from the
layout rules the corpus renderer follows (which line each field lands on, which
rule each style exercises, which fields each frontend reads); no source text
is parsed. Scalar queries restate the scoring and URL rules in SQL.
"""
from __future__ import annotations

from deadwire.functions import noise as N
from deadwire.plans.oracle_forms import FORMS_ORACLE
from deadwire.sources.derived import BUCKET, NAME_PARTS, TIER_BYTES

_name_case = " ".join(
    f"WHEN {i} THEN '{pre}' || CAST(p_partkey AS VARCHAR) || '{suf}'" for i, (pre, suf) in enumerate(NAME_PARTS))
_bytes_case = " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(TIER_BYTES))

BASE = f"""
rk AS (SELECT DISTINCT l_partkey AS rk FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
p0 AS (SELECT p_partkey, p_size, CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS bn,
              p_partkey // {BUCKET} AS bucket, rk.rk IS NOT NULL AS is_read
       FROM part LEFT JOIN rk ON rk.rk = part.p_partkey),
p AS (SELECT p_partkey, p_size, bn, bucket, is_read,
             'brand' || CAST(bn AS VARCHAR) AS repo,
             CASE p_size % 12 {_name_case} END AS name,
             CASE p_size % 12 {_bytes_case} END AS bytes,
             CASE (bucket + bn) % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'ts' ELSE 'java' END AS lang,
             (bucket + 3 * bn) % 3 AS style,
             (bucket + bn) % 10 <> 9 AS has_fe,
             row_number() OVER (PARTITION BY bn, bucket ORDER BY p_partkey) AS pos,
             count(*) OVER (PARTITION BY bn, bucket) AS n_parts,
             sum(CASE WHEN is_read THEN 1 ELSE 0 END) OVER (PARTITION BY bn, bucket) AS n_read,
             sum(CASE WHEN is_read THEN 1 ELSE 0 END) OVER (
                 PARTITION BY bn, bucket ORDER BY p_partkey
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rpos
      FROM p0),
f AS (SELECT *,
        repo || '/backend/b' || CAST(bucket AS VARCHAR) || '.' || lang AS be_path,
        repo || '/frontend/b' || CAST(bucket AS VARCHAR) || '.ts' AS fe_path,
        CASE WHEN lang = 'java' THEN 'POST' ELSE 'GET' END AS method,
        CASE WHEN lang = 'java' THEN 'POST' ELSE 'GET' END || ' /api/' || repo || '/b'
            || CAST(bucket AS VARCHAR) || '/:param' AS pattern,
        CAST(CASE lang WHEN 'py' THEN 7 + pos
                       WHEN 'go' THEN (CASE WHEN style % 2 = 0 THEN 8 ELSE 5 END) + pos
                       WHEN 'ts' THEN 5 + pos END AS INTEGER) AS be_line,
        CAST(12 + n_read + rpos AS INTEGER) AS dto_line,
        CASE lang WHEN 'py' THEN (CASE style WHEN 0 THEN 'py_jsonify' WHEN 1 THEN 'py_return_dict'
                                 ELSE 'py_json_response' END)
                  WHEN 'go' THEN (CASE WHEN style % 2 = 0 THEN 'go_gin_h' ELSE 'go_struct' END)
                  WHEN 'ts' THEN (CASE style WHEN 2 THEN 'ts_res_json_var' ELSE 'ts_res_json' END) END AS be_rule,
        CASE style WHEN 0 THEN 'ts_options_body' WHEN 1 THEN 'ts_options_body_var' ELSE 'ts_axios_body' END AS fe_rule,
        CAST(bytes AS BIGINT) * (CASE WHEN lang = 'java' THEN 5000 ELSE 10000 END) AS ep_waste,
        CAST(bytes AS BIGINT) * 10000 AS gl_waste
      FROM p),
ep_dead AS (
  SELECT repo, pattern, method, be_path AS backend_file, be_path AS path, lang, 'response' AS side,
         be_rule AS rule, name, be_line AS line, ep_waste AS waste_score
  FROM f WHERE lang <> 'java' AND has_fe AND NOT is_read
  UNION ALL
  SELECT repo, pattern, method, be_path AS backend_file, fe_path AS path, 'ts' AS lang, 'request' AS side,
         fe_rule AS rule, name, CAST(5 + pos AS INTEGER) AS line, ep_waste AS waste_score
  FROM f WHERE lang = 'java' AND has_fe AND NOT is_read),
gl_dead AS (
  SELECT repo, be_path AS path, lang, 'response' AS side, be_rule AS rule, name, be_line AS line,
         gl_waste AS waste_score
  FROM f WHERE lang <> 'java' AND NOT (has_fe AND is_read)
  UNION ALL
  SELECT repo, be_path AS path, lang, 'response' AS side, 'java_dto' AS rule, name, dto_line AS line,
         gl_waste AS waste_score
  FROM f WHERE lang = 'java' AND is_read),
ledger AS (
  SELECT 'endpoint' AS source, repo, pattern, path, side, name, line, waste_score FROM ep_dead
  UNION ALL
  SELECT 'global' AS source, repo, CAST(NULL AS VARCHAR) AS pattern, path, side, name, line, waste_score
  FROM gl_dead)
"""


#: A whole word in any script that starts like an identifier.
WORD = "[\\p{L}_][\\p{L}\\p{M}\\p{N}_]*"


def _with(sql: str) -> str:
    return "WITH " + BASE.strip() + "\n" + sql


def _ends(n: str, *words: str) -> str:
    return "(" + " OR ".join(f"ends_with({n}, '{w}')" for w in words) + ")"


def _has(n: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({n}, '{w}')" for w in words) + ")"


def tier_sql(word: str) -> str:
    n = f"lower({word})"
    return f"""CASE
      WHEN regexp_matches({n}, '^(is|has|can|should|was|did|enabled|active|visible|deleted|verified|confirmed|success|failed|done)')
           OR {_ends(n, "enabled", "active", "visible")} THEN 'bool'
      WHEN {n} = 'id' OR {_ends(n, "id", "uuid", "guid")} OR regexp_matches({n}, '[_-]id$') THEN 'id'
      WHEN regexp_matches({n}, '^(count|total|num|number|age|score|size|length|limit|offset|page|rank|index|version|code|status)')
           OR ends_with({n}, 'count') THEN 'count'
      WHEN regexp_matches({n}, '^(created|updated|deleted|modified|published|expires|started|ended|timestamp|date|time)')
           OR {_ends(n, "at", "date", "time", "timestamp")} THEN 'time'
      WHEN {_has(n, "email", "mail")} THEN 'email'
      WHEN {_has(n, "url", "uri", "link", "href", "path")} THEN 'url'
      WHEN {_has(n, "token", "hash", "secret", "key", "signature")} THEN 'token'
      WHEN {_has(n, "name", "title", "label", "slug")} THEN 'name'
      WHEN {_has(n, "message", "description", "content", "body", "text", "bio")} THEN 'text'
      WHEN {_has(n, "data", "meta", "info", "config", "settings", "options")} THEN 'object'
      WHEN {_has(n, "list", "items", "array", "tags", "roles")} OR ends_with({n}, 's') THEN 'list'
      ELSE 'default' END"""


def bytes_sql(tier: str) -> str:
    return (f"CASE {tier} WHEN 'bool' THEN 5 WHEN 'id' THEN 38 WHEN 'count' THEN 6 WHEN 'time' THEN 26 "
            "WHEN 'email' THEN 27 WHEN 'url' THEN 52 WHEN 'token' THEN 66 WHEN 'name' THEN 22 WHEN 'text' THEN 80 "
            "WHEN 'object' THEN 64 WHEN 'list' THEN 40 ELSE 22 END")


def requests_sql(p: str) -> str:
    lp = f"lower({p})"
    seg = lambda w: f"regexp_matches({lp}, '/({w})(/|$)')"
    return f"""CAST(CASE
      WHEN {p} IS NULL OR {p} = '' THEN 10000
      WHEN {seg("health|ping|status|ready|live")} THEN 100000
      WHEN {seg("auth|login|logout|signin|signout|session|token|refresh")} THEN 50000
      WHEN {seg("admin|internal|debug|metrics|_")} THEN 500
      WHEN regexp_matches({lp}, '/webhook') THEN 1000
      WHEN regexp_matches({p}, '^(POST|PUT|PATCH|DELETE)') THEN 5000
      ELSE 10000 END AS INTEGER)"""


def normalize_sql(x: str) -> str:
    for pat in [r"\$\{[^}]+\}", r":[A-Za-z_][A-Za-z0-9_]*", r"<[^>]+>", r"\{[^}]+\}"]:
        x = f"regexp_replace({x}, '{pat}', ':param', 'g')"
    return x


def words_sql(w: str) -> str:
    n = f"CAST({w} AS BIGINT)"
    b, m, k = f"({n} // 1000000000)", f"(({n} % 1000000000) // 1000000)", f"(({n} % 1000000) // 1000)"
    part = lambda v, s: f"CASE WHEN {v} > 0 THEN CAST({v} AS VARCHAR) || ' {s}' END"
    return f"""CASE
      WHEN {n} >= 1000000000 THEN concat_ws(' ', CAST({b} AS VARCHAR) || ' billion', {part(m, 'million')},
                                            {part(k, 'thousand')}) || ' bytes'
      WHEN {n} >= 1000000 THEN concat_ws(' ', CAST({m} AS VARCHAR) || ' million', {part(k, 'thousand')}) || ' bytes'
      WHEN {n} >= 1000 THEN CAST({k} AS VARCHAR) || ' thousand bytes'
      ELSE CAST({n} AS VARCHAR) || ' bytes' END"""


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 1.0::DOUBLE ELSE CAST({num} AS DOUBLE) / ({den}) END"


# The truth differs from what the sources show: a part of size 1 is read by a client outside
# the corpus, and a read of a part of size 2 is a leftover that counts as dead.
_SCORED = """SELECT repo, CAST(count(*) FILTER (NOT is_read AND p_size <> 1) AS BIGINT) AS tp,
       CAST(count(*) FILTER (NOT is_read AND p_size = 1) AS BIGINT) AS fp,
       CAST(count(*) FILTER (is_read AND p_size = 2) AS BIGINT) AS fn
FROM f WHERE has_fe GROUP BY repo"""

FACTS = "repo, {path} AS path, {lang} AS lang, '{side}' AS side, {rule} AS rule, name, {line} AS line"

ORACLE = {
    "scan_lang_counts": _with("""
SELECT lang, CAST(count(*) AS BIGINT) AS n_files FROM (
  SELECT DISTINCT bn, bucket, lang FROM f
  UNION ALL
  SELECT DISTINCT bn, bucket, 'ts' AS lang FROM f WHERE has_fe) t
GROUP BY lang"""),
    "route_registry": _with("""
SELECT DISTINCT repo, pattern, method, be_path AS backend_file, lang AS backend_lang,
       CAST(CASE WHEN has_fe THEN 1 ELSE 0 END AS BIGINT) AS n_frontend,
       CASE WHEN has_fe THEN fe_path END AS first_frontend
FROM f"""),
    "defs_py": _with("SELECT " + FACTS.format(path="be_path", lang="lang", side="response", rule="be_rule",
                                              line="be_line") + " FROM f WHERE lang = 'py'"),
    "defs_go": _with("SELECT " + FACTS.format(path="be_path", lang="lang", side="response", rule="be_rule",
                                              line="be_line") + " FROM f WHERE lang = 'go'"),
    "defs_ts_response": _with("SELECT " + FACTS.format(path="be_path", lang="lang", side="response",
                                                       rule="be_rule", line="be_line")
                              + " FROM f WHERE lang = 'ts'"),
    "defs_ts_request": _with("SELECT " + FACTS.format(path="fe_path", lang="'ts'", side="request",
                                                      rule="fe_rule",
                                                      line="CAST(5 + pos AS INTEGER)")
                             + " FROM f WHERE lang = 'java' AND has_fe"),
    "reads_ts": _with("SELECT " + FACTS.format(
        path="fe_path", lang="'ts'", side="response",
        rule="CASE WHEN p_partkey % 4 = 3 THEN 'ts_destructure' ELSE 'ts_property' END",
        line="CAST(5 + rpos AS INTEGER)") + " FROM f WHERE lang <> 'java' AND has_fe AND is_read"
        " UNION ALL SELECT DISTINCT " + FACTS.format(path="be_path", lang="'ts'", side="response", rule="'ts_property'",
                                                     line="5").replace(", name,", ", 'status' AS name,")
        + " FROM f WHERE lang = 'ts' AND style = 0"),
    "defs_java": _with("SELECT " + FACTS.format(path="be_path", lang="lang", side="response", rule="'java_dto'",
                                                line="dto_line") + " FROM f WHERE lang = 'java' AND is_read"),
    "reads_py": _with("""
SELECT DISTINCT repo, be_path AS path, lang, 'request' AS side, 'py_args_get' AS rule,
       'sort' || CAST(bucket AS VARCHAR) AS name, CAST(6 AS INTEGER) AS line
FROM f WHERE lang = 'py' AND style <> 2"""),
    "reads_go": _with("""
SELECT DISTINCT repo, be_path AS path, lang, 'request' AS side, 'go_query' AS rule,
       'page' || CAST(bucket AS VARCHAR) AS name,
       CAST(CASE WHEN style % 2 = 0 THEN 7 ELSE 10 + n_parts END AS INTEGER) AS line
FROM f WHERE lang = 'go'"""),
    "reads_java": _with("SELECT " + FACTS.format(path="be_path", lang="'java'", side="request",
                                                 rule="'java_getter'", line="CAST(8 + rpos AS INTEGER)")
                        + " FROM f WHERE lang = 'java' AND is_read"),
    "dead_fields": _with("SELECT * FROM ep_dead"),
    "global_dead": _with("SELECT * FROM gl_dead"),
    "global_lang_totals": _with("""
SELECT repo, lang, CAST(count(*) AS BIGINT) AS scanned,
       CAST(sum(CASE WHEN lang = 'java' OR NOT (has_fe AND is_read) THEN 1 ELSE 0 END) AS BIGINT) AS dead,
       CAST(sum(CASE WHEN lang = 'java' OR NOT (has_fe AND is_read) THEN gl_waste ELSE 0 END) AS BIGINT)
         AS waste_score
FROM f WHERE lang <> 'java' OR is_read GROUP BY repo, lang"""),
    "summary": _with(f"""
, r AS (
  SELECT repo,
    CAST(count(DISTINCT bucket) AS BIGINT) AS n_endpoints,
    CAST(sum(CASE WHEN has_fe AND NOT is_read THEN 1 ELSE 0 END) AS BIGINT) AS endpoint_dead,
    CAST(sum(CASE WHEN (lang <> 'java' AND NOT (has_fe AND is_read)) OR (lang = 'java' AND is_read)
                  THEN 1 ELSE 0 END) AS BIGINT) AS global_dead,
    CAST(sum(CASE WHEN has_fe THEN 1 ELSE 0 END)
         + sum(CASE WHEN lang <> 'java' OR is_read THEN 1 ELSE 0 END) AS BIGINT) AS response_fields,
    CAST(sum(CASE WHEN has_fe AND NOT is_read THEN ep_waste ELSE 0 END)
       + sum(CASE WHEN (lang <> 'java' AND NOT (has_fe AND is_read)) OR (lang = 'java' AND is_read)
                  THEN gl_waste ELSE 0 END) AS BIGINT)
       AS waste_bytes
  FROM f GROUP BY repo)
SELECT repo, n_endpoints, endpoint_dead, global_dead, endpoint_dead + global_dead AS total_dead,
       response_fields, waste_bytes,
       round(CAST(waste_bytes AS DOUBLE) / 1000.0, 1) AS waste_kb,
       round(CAST(waste_bytes AS DOUBLE) * 6e-11 * 1000.0, 6) AS energy_wh,
       CASE WHEN response_fields > 0
            THEN round(CAST(endpoint_dead + global_dead AS DOUBLE) / CAST(response_fields AS DOUBLE) * 100.0)
            ELSE 0.0 END AS dead_pct,
       {words_sql('waste_bytes')} AS waste_words
FROM r"""),
    "ledger": _with("""
SELECT source, repo, pattern, path, side, name, line, waste_score,
       path || ':' || CAST(line AS VARCHAR) AS defined_at,
       regexp_extract(path, '([^/\\\\]*)$', 1) AS file_name,
       '''' || name || ''' is defined but never accessed by the '
         || CASE WHEN side = 'response' THEN 'frontend' ELSE 'backend' END
         || '. Estimated waste: ~' || format('{:,.2f}', CAST(waste_score AS DOUBLE)) || ' bytes/day' AS message,
       round(CAST(waste_score AS DOUBLE) / 1000.0, 1) AS waste_kb,
       round(CAST(waste_score AS DOUBLE) * 6.916e-8, 6) AS carbon_g
FROM ledger"""),
    "findings_by_file": _with("""
SELECT repo, path, CAST(count(*) AS BIGINT) AS n_findings, CAST(sum(waste_score) AS BIGINT) AS waste_score,
       min(line) AS first_line
FROM ledger GROUP BY repo, path"""),
    "accuracy": _with(f"""
SELECT repo, tp, fp, fn, {_ratio("tp", "tp + fp")} AS precision, {_ratio("tp", "tp + fn")} AS recall
FROM ({_SCORED}) t"""),
    "url_normalize": f"""
WITH u AS (SELECT url AS href FROM pages
           UNION ALL
           SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
n AS (SELECT {normalize_sql('href')} AS path FROM u)
SELECT path, CAST(count(*) AS BIGINT) AS n, {requests_sql("'GET ' || path")} AS get_requests,
       {requests_sql("'POST ' || path")} AS post_requests
FROM n GROUP BY path""",
    "field_bytes_tiers": f"""
WITH w AS (SELECT unnest(regexp_extract_all(text, '{WORD}', 0)) AS word FROM documents),
t AS (SELECT word, {tier_sql('word')} AS tier FROM w)
SELECT tier, CAST({bytes_sql('tier')} AS INTEGER) AS bytes, CAST(count(*) AS BIGINT) AS n_words,
       CAST(count(DISTINCT word) AS BIGINT) AS n_distinct
FROM t GROUP BY tier""",
}


def _noise_values() -> str:
    rows = [("ts", "read", w) for w in N.TS_READ_NOISE]
    for lang, kind, lst in [("py", "def", N.PY_DEF_NOISE), ("py", "read", N.PY_READ_NOISE),
                            ("java", "def", N.JAVA_DEF_NOISE), ("java", "read", N.JAVA_READ_NOISE),
                            ("go", "def", N.GO_DEF_NOISE), ("go", "read", N.GO_READ_NOISE)]:
        rows += [(lang, kind, w) for w in N.words(lst)]
    return ",\n".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows)


ORACLE["noise_filter"] = f"""
WITH nt(lang, kind, name) AS (VALUES {_noise_values()}),
w AS (SELECT unnest(regexp_extract_all(text, '{WORD}', 0)) AS name FROM documents)
SELECT nt.lang, nt.kind, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT w.name) AS BIGINT) AS distinct_names
FROM w JOIN nt ON w.name = nt.name GROUP BY nt.lang, nt.kind"""

ORACLE["position_lookup"] = _with("""
SELECT repo, path, line, name, CAST(min(waste_score) AS BIGINT) AS waste_score
FROM (SELECT *, min(name) OVER (PARTITION BY repo, path, line) AS first_name FROM ledger) t
WHERE name = first_name GROUP BY repo, path, line, name""")

# Streaming re-analysis ends in the same state as the batch job.
ORACLE["incremental_rescan"] = ORACLE["dead_fields"]

_NUMBER = "CAST(regexp_extract(repo, '[0-9]+') AS INTEGER)"

# Every batch rewrites the repos whose files it changes: all, those of even number, the others.
ORACLE["rescan_touched"] = _with(f"""
SELECT 'finding' AS kind, CAST(NULL AS BIGINT) AS batch, repo, source, pattern, path, side, name, line, waste_score
FROM ledger
UNION ALL
SELECT DISTINCT 'rewrite', CAST(0 AS BIGINT), repo, NULL, NULL, NULL, NULL, NULL, CAST(NULL AS INTEGER), CAST(NULL AS BIGINT)
FROM f
UNION ALL
SELECT DISTINCT 'rewrite', CAST(CASE WHEN {_NUMBER} % 2 = 0 THEN 1 ELSE 2 END AS BIGINT), repo, NULL, NULL, NULL, NULL, NULL,
       CAST(NULL AS INTEGER), CAST(NULL AS BIGINT)
FROM f WHERE has_fe""")

ORACLE["edit_withdrawn"] = _with(f"""
SELECT source, repo, pattern, path, side, name, line, waste_score FROM ledger
WHERE path NOT LIKE '%/backend/%' OR ({_NUMBER} % 3 <> 2 AND {_NUMBER} % 5 <> 4)""")



def _offsets(table: str, key: str, text: str, rule: str, pattern: str) -> str:
    """Starts and lines of the matches: what precedes a match are the gaps up to it and the matches before it."""
    return f"""
SELECT '{table}/' || id AS path, '{rule}' AS rule,
       CAST(sum(length(gap) + length(hit)) OVER w - length(hit) AS INTEGER) AS start,
       CAST(1 + sum(length(gap) - length(replace(gap, chr(10), '')) + length(hit) - length(replace(hit, chr(10), ''))) OVER w
            - (length(hit) - length(replace(hit, chr(10), ''))) AS INTEGER) AS line
FROM (SELECT id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i
      FROM (SELECT {key}::VARCHAR AS id, regexp_extract_all({text}, '{pattern}') AS hits,
                   regexp_split_to_array({text}, '{pattern}') AS gaps FROM {table}))
WINDOW w AS (PARTITION BY id ORDER BY i)"""


ORACLE["match_offsets"] = " UNION ALL ".join((
    _offsets("pages", "page_id", "html", "href", 'href="[^"]*"'),
    _offsets("pages", "page_id", "html", "open_tag", "<[a-z][a-z0-9]*"),
    _offsets("documents", "doc_id", "text", "long_word", "[A-Za-z]{8,}"),
    _offsets("documents", "doc_id", "text", "line_end", "\\n")))

ORACLE["range_containment"] = f"""
WITH links AS ({_offsets("pages", "page_id", "html", "href", 'href="[^"]*"')}),
tags AS ({_offsets("pages", "page_id", "html", "open_tag", "<[a-z][a-z0-9]*")}),
t AS (SELECT path, start, row_number() OVER (PARTITION BY path ORDER BY start) - 1 AS i FROM tags),
r AS (SELECT a.path, a.start, b.start AS stop FROM t a JOIN t b ON a.path = b.path AND b.i = a.i + 1 + a.i % 3
      WHERE a.i % 3 = 0 OR a.i % 7 = 0)
SELECT CAST(replace(path, 'pages/', '') AS BIGINT) AS page_id, start AS at FROM links
WHERE EXISTS (SELECT 1 FROM r WHERE r.path = links.path AND links.start >= r.start AND links.start < r.stop)"""

# Blanks, then ':', '/', digits and letters, whatever their case (upper case occurs in methods only).
ORACLE["endpoint_order"] = FORMS_ORACLE["registry_forms"].replace(
    "SELECT repo, pattern, method, backend_file, backend_lang, n_frontend, first_frontend FROM e",
    "SELECT repo, pattern, row_number() OVER (ORDER BY lower(translate(pattern, ' :/', '!\"#')), repo) AS rank FROM e")

ORACLE["truth_accounting"] = _with("""
SELECT repo, count(DISTINCT bucket) FILTER (bucket % 5 IN (0, 4)) AS n_parsed,
       count(DISTINCT bucket) FILTER (bucket % 5 IN (1, 2, 3)) AS n_bad,
       count(*) FILTER (bucket % 5 IN (0, 4) AND NOT is_read) AS n_dead_fields,
       count(DISTINCT bucket) FILTER (bucket % 3 = 0) AS n_facts_parsed,
       count(DISTINCT bucket) FILTER (bucket % 3 <> 0) AS n_facts_bad,
       count(*) FILTER (bucket % 3 = 0) + count(*) FILTER (bucket % 3 = 0 AND is_read) AS n_facts
FROM f GROUP BY repo""")

ORACLE["report_documents"] = _with("""
, items AS (
  SELECT DISTINCT repo, 'endpoints' AS section, '' AS pattern, pattern AS name, CAST(NULL AS VARCHAR) AS side, be_path AS path,
         CAST(NULL AS INTEGER) AS line, CAST(NULL AS BIGINT) AS waste_score, lower(translate(pattern, ' :/', '!"#')) AS first_key
  FROM f
  UNION ALL
  SELECT repo, CASE source WHEN 'endpoint' THEN 'deadFieldAnalysis' ELSE 'globalDeadFieldAnalysis' END, coalesce(pattern, ''),
         name, side, path, line, waste_score, path FROM ledger),
n AS (SELECT *, row_number() OVER (PARTITION BY repo, section, pattern ORDER BY first_key, line, lower(name)) AS place FROM items)
SELECT repo, section, pattern, (place - 1) // 50 AS chunk, place, name, side, path, line, waste_score FROM n""")

ORACLE["accuracy_overall"] = _with(f"""
SELECT CAST(count(*) AS BIGINT) AS projects, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
       CAST(sum(fn) AS BIGINT) AS fn, avg({_ratio("tp", "tp + fp")}) AS macro_precision,
       avg({_ratio("tp", "tp + fn")}) AS macro_recall,
       coalesce(nullif(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp) + sum(fp), 0), 0.0), 1.0) AS micro_precision,
       coalesce(nullif(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp) + sum(fn), 0), 0.0), 1.0) AS micro_recall
FROM ({_SCORED}) t""")

ORACLE["report_endpoints"] = _with("""
SELECT DISTINCT repo, pattern, method, be_path AS backend_file, CAST(CASE WHEN has_fe THEN 1 ELSE 0 END AS BIGINT)
       AS n_frontend,
       CAST(CASE WHEN has_fe THEN n_parts ELSE 0 END AS BIGINT) AS n_defined,
       CAST(CASE WHEN has_fe THEN n_read ELSE 0 END AS BIGINT) AS n_accessed,
       CAST(CASE WHEN has_fe THEN n_parts - n_read ELSE 0 END AS BIGINT) AS n_dead,
       CAST(CASE WHEN has_fe THEN sum(CASE WHEN is_read THEN 0 ELSE ep_waste END) OVER (PARTITION BY bn, bucket) ELSE 0
            END AS BIGINT) AS waste_score
FROM f""")

ORACLE |= FORMS_ORACLE
