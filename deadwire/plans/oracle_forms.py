"""Oracle SQL of the rule-form queries: what each template of ``sources/forms.py`` must yield, written
out by hand per template (number, language, extractor, side, rule, name, line)."""
from __future__ import annotations

_FACTS = """
(0, 'py', 'py_defs', 'response', 'py_return_dict', 'delta%%', 12),
(0, 'py', 'py_defs', 'response', 'py_return_dict', 'eps%%', 19),
(0, 'py', 'py_defs', 'request', 'py_model', 'alpha%%', 4),
(0, 'py', 'py_defs', 'request', 'py_model', 'beta%%', 5),
(0, 'py', 'py_defs', 'request', 'py_model', 'gamma%%', 8),
(0, 'py', 'py_reads', 'request', 'py_model_param', 'alpha%%', 11),
(0, 'py', 'py_reads', 'request', 'py_model_param', 'beta%%', 11),
(0, 'py', 'py_reads', 'request', 'py_model_param', 'gamma%%', 18),
(1, 'py', 'py_reads', 'request', 'py_json_get', 'alpha%%', 5),
(1, 'py', 'py_reads', 'request', 'py_json_index', 'beta%%', 6),
(1, 'py', 'py_reads', 'request', 'py_alias_get', 'gamma%%', 8),
(1, 'py', 'py_reads', 'request', 'py_alias_index', 'delta%%', 9),
(1, 'py', 'py_reads', 'request', 'py_form_get', 'eps%%', 10),
(1, 'py', 'py_reads', 'request', 'py_args_get', 'zeta%%', 11),
(2, 'java', 'java_defs', 'response', 'java_dto', 'alphaP%%', 4),
(2, 'java', 'java_defs', 'response', 'java_dto', 'beta_%%', 5),
(2, 'java', 'java_defs', 'response', 'java_put', 'gamma%%', 9),
(2, 'java', 'java_defs', 'response', 'java_map_of', 'omega%%', 10),
(2, 'java', 'java_defs', 'response', 'java_map_of', 'eps%%', 10),
(2, 'java', 'java_reads', 'request', 'java_dto_all', 'zetaP%%', 20),
(2, 'java', 'java_reads', 'request', 'java_param_named', 'eta%%', 24),
(2, 'java', 'java_reads', 'request', 'java_param_typed', 'theta%%', 24),
(2, 'java', 'java_reads', 'request', 'java_direct', 'iota%%', 25),
(2, 'java', 'java_reads', 'request', 'java_get_parameter', 'kappa%%', 25),
(3, 'go', 'go_defs', 'response', 'go_struct', 'beta%%', 8),
(3, 'go', 'go_defs', 'response', 'go_struct', 'gamma%%', 10),
(3, 'go', 'go_defs', 'response', 'go_map_literal', 'zeta%%', 18),
(3, 'go', 'go_defs', 'response', 'go_map_literal', 'eta%%', 20),
(3, 'go', 'go_reads', 'request', 'go_decode', 'alpha%%', 15),
(3, 'go', 'go_reads', 'request', 'go_query_get', 'delta%%', 16),
(3, 'go', 'go_reads', 'request', 'go_form_value', 'eps%%', 17),
(4, 'go', 'go_defs', 'response', 'go_gin_h', 'omega%%', 13),
(4, 'go', 'go_defs', 'response', 'go_gin_h', 'eps%%', 13),
(4, 'go', 'go_reads', 'request', 'go_bind_json', 'alpha%%', 10),
(4, 'go', 'go_reads', 'request', 'go_post_form', 'beta%%', 11),
(4, 'go', 'go_reads', 'request', 'go_query', 'gamma%%', 12),
(5, 'ts', 'ts_response_defs', 'response', 'ts_res_json', 'alpha%%', 4),
(5, 'ts', 'ts_response_defs', 'response', 'ts_res_json', 'nested%%', 4),
(5, 'ts', 'ts_response_defs', 'response', 'ts_res_json', 'used##s', 4),
(5, 'ts', 'ts_response_defs', 'response', 'ts_res_json', 'spare##s', 4),
(5, 'ts', 'ts_reads', 'response', 'ts_property', 'status', 4),
(6, 'ts', 'ts_request_defs', 'request', 'ts_axios_body', 'alpha%%', 4),
(6, 'ts', 'ts_request_defs', 'request', 'ts_stringify', 'beta%%', 5),
(6, 'ts', 'ts_request_defs', 'request', 'ts_stringify', 'gamma%%', 5),
(6, 'ts', 'ts_reads', 'response', 'ts_property', 'doFetch', 2),
(6, 'ts', 'ts_reads', 'response', 'ts_property', 'getUserRoute', 2),
(6, 'ts', 'ts_reads', 'response', 'ts_property', 'delta%%', 7),
(6, 'ts', 'ts_reads', 'response', 'ts_property', 'used##s', 7)"""

# a Go handler on http is found by the gorilla rule first; the same route counts once per file
_ROUTES = """
(0, 'py', 1, 'backend', 'express', 'POST', '/forms/x%%/a'),
(0, 'py', 1, 'backend', 'express', 'POST', '/forms/x%%/b'),
(1, 'py', 1, 'backend', 'flask', 'GET', '/forms/shared/s##'),
(2, 'java', 2, 'backend', 'spring', 'PUT', '/forms/x%%/d'),
(2, 'java', 2, 'backend', 'spring', 'PATCH', '/forms/x%%/e'),
(3, 'go', 3, 'backend', 'gorilla', 'GET', '/forms/x%%/f'),
(3, 'go', 3, 'backend', 'gorilla', 'PUT', '/forms/x%%/g'),
(3, 'go', 3, 'backend', 'gorilla', 'PATCH', '/forms/x%%/h'),
(4, 'go', 3, 'backend', 'gin', 'POST', '/forms/x%%/i'),
(5, 'ts', 0, 'backend', 'express', 'GET', '/forms/shared/s##'),
(5, 'ts', 0, 'backend', 'chained', 'POST', '/forms/x%%/j'),
(6, 'ts', 0, 'frontend', 'fetch', 'GET', '/forms/shared/s##'),
(6, 'ts', 0, 'frontend', 'axios', 'PATCH', '/forms/x%%/k'),
(6, 'ts', 0, 'frontend', 'do_fetch', 'PUT', '/api/v4/users/:param/x%%')"""

# the first name of each line that defines response fields (lines 10 of Java and 13 of gin have another
# alphabetical order)
_FIRST = """
(0, 'py', 12, 'delta%%'), (0, 'py', 19, 'eps%%'),
(2, 'java', 4, 'alphaP%%'), (2, 'java', 5, 'beta_%%'), (2, 'java', 9, 'gamma%%'), (2, 'java', 10, 'omega%%'),
(3, 'go', 8, 'beta%%'), (3, 'go', 10, 'gamma%%'), (3, 'go', 18, 'zeta%%'), (3, 'go', 20, 'eta%%'),
(4, 'go', 13, 'omega%%'), (5, 'ts', 4, 'alpha%%')"""


def _put(column: str) -> str:
    return f"replace(replace({column}, '%%', key), '##', block)"


_BASE = f"""
WITH facts(form, lang, ext, side, rule, named, line) AS (VALUES {_FACTS}),
routed(form, lang, lang_rank, role, rule, method, address) AS (VALUES {_ROUTES}),
parts AS (SELECT 'brand' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS repo, p_partkey % 7 AS form,
                 CAST(p_partkey AS VARCHAR) AS key, CAST(p_partkey // 200 AS VARCHAR) AS block FROM part),
f AS (SELECT repo, 'forms/t' || form || '/p' || key || '.' || lang AS path, lang, ext, side, rule,
             {_put('named')} AS name, CAST(line AS INTEGER) AS line
      FROM parts JOIN facts USING (form)),
r AS (SELECT repo, 'forms/t' || form || '/p' || key || '.' || lang AS path, lang, CAST(lang_rank AS INTEGER) AS lang_rank,
             role, rule, method, {_put('address')} AS url
      FROM parts JOIN routed USING (form)),
e AS (SELECT repo, method || ' ' || url AS pattern, method,
             arg_min(path, (lang_rank, path)) FILTER (role = 'backend') AS backend_file,
             arg_min(lang, (lang_rank, path)) FILTER (role = 'backend') AS backend_lang,
             count(DISTINCT path) FILTER (role = 'frontend') AS n_frontend,
             min(path) FILTER (role = 'frontend') AS first_frontend
      FROM r GROUP BY repo, method, url)
"""

FORMS_ORACLE = {
    "rule_forms": _BASE + "SELECT repo, path, lang, ext, side, rule, name, line FROM f",
    "route_forms": _BASE + "SELECT repo, path, lang, role, rule, method, url FROM r",
    "registry_forms": _BASE + "SELECT repo, pattern, method, backend_file, backend_lang, n_frontend, first_frontend FROM e",
    # the first backend in (language, path) order answers for the endpoint; one caller's read saves a field
    "dead_forms": _BASE + """
SELECT e.repo, e.pattern, e.backend_file, d.side, d.rule, d.name, d.line
FROM e JOIN f d ON d.repo = e.repo AND d.path = e.backend_file AND d.ext IN ('ts_response_defs', 'py_defs')
WHERE e.n_frontend > 0 AND NOT EXISTS (
    SELECT 1 FROM r c JOIN f u ON u.repo = c.repo AND u.path = c.path AND u.ext = 'ts_reads'
    WHERE c.role = 'frontend' AND c.repo = e.repo AND c.method || ' ' || c.url = e.pattern AND u.name = d.name)""",
    "position_forms": f"""
WITH first(form, lang, line, named) AS (VALUES {_FIRST})
SELECT 'brand' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS repo,
       'forms/t' || form || '/p' || p_partkey || '.' || lang AS path, CAST(line AS INTEGER) AS line,
       replace(named, '%%', CAST(p_partkey AS VARCHAR)) AS name
FROM part JOIN first ON p_partkey % 7 = form""",
}
