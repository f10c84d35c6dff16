"""Queries over source text: rules, secrets, routes, checks, taint."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators import routes as T
from auditframe.operators import rules as R
from auditframe.operators import taint as X
from auditframe.queries import inputs as IN
from auditframe.queries.registry import CHECKS, query
from auditframe.session import durable
from auditframe.sources.config import overlay_config

# Lines of the code files, numbered from 1, for the checking SQL.
_CODE_LINES = """code_lines AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS t,
 CAST(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INTEGER) AS line FROM code_files)"""
_JS = "regexp_matches(path, '\\.(js|ts)$')"
_PY = "regexp_matches(path, '\\.py$')"
_LISTED = "NOT contains(path, 'node_modules/')"


# --- rules -----------------------------------------------------------------


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULE_ROWS = ",\n".join(
    f"({_quote(r.rule_id)}, '{r.language}', '{r.severity}', '{r.category}', '{r.confidence}', {_quote(r.pattern)})"
    for r in R.LINE_RULES
)
_RULE_HITS = f"""{_CODE_LINES},
rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS r(rule_id, language, severity, category, confidence, pattern)),
hits AS (SELECT repo, path, line, rule_id, severity, category, confidence FROM code_lines l JOIN rules r
 ON (CASE WHEN {_JS} THEN 'js' WHEN {_PY} THEN 'py' END) = r.language AND regexp_matches(l.t, r.pattern)
 WHERE NOT regexp_matches(l.t, '^\\s*(//|#)'))"""


@query(f"WITH {_RULE_HITS} SELECT * FROM hits", ["code_files"])
def rule_scan(spark, sf_dir):
    return R.scan_rules(IN.code_files(spark, sf_dir))


@query(
    f"""WITH {_RULE_HITS} SELECT * FROM hits
UNION ALL SELECT repo, path, line, concat('imports-m', CAST(s_suppkey AS STRING)), 'low', 'other', 'high' FROM code_lines JOIN supplier
 ON contains(t, concat('/m', CAST(s_suppkey AS STRING), '"')) WHERE {_JS}""",
    ["code_files"],
)
def rule_table_scan(spark, sf_dir):
    """Rules from a table: the fixed ones and one for each supplier, about modules that a file imports."""
    name = F.concat(F.lit("m"), F.col("s_suppkey").cast("string"))
    more = IN.load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("imports-"), name).alias("rule_id"), F.lit("js").alias("language"), F.lit("low").alias("severity"),
        F.lit("other").alias("category"), F.lit("high").alias("confidence"), F.concat(F.lit("/"), name, F.lit('"')).alias("pattern"),
        F.array(F.concat(F.lit("/"), name, F.lit('"'))).alias("needles"), F.array(F.array(name)).alias("words"),
    )
    return R.scan_rule_table(IN.code_files(spark, sf_dir), R.table_of_rules(spark).union(more))


# Comments, heads of handlers, strings and brackets as tokens; a running depth says where each call ends.
_HEAD = r"""\.post\(\s*(?:"[^"]*"|'[^']*')\s*,\s*(?:async\s*)?(?:function\s*\([^()]*\)|\([^()]*\)\s*=>)\s*\{"""
_PIECES = rf"""(?s)//[^\n]*|/\*.*?\*/|{_HEAD}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[()\[\]{{}}]|[^()\[\]{{}}"'`/.]+|.""".replace("'", "''")
_HEAD = _HEAD.replace("'", "''")


@query(
    f"""WITH listed AS (SELECT repo, path, regexp_extract_all(content, '{_PIECES}') AS p FROM code_files WHERE {_JS}),
tokens AS (SELECT repo, path, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS i FROM listed),
placed AS (SELECT *, CASE WHEN regexp_matches(t, '^(?:{_HEAD})$') THEN 2 WHEN t IN ('(', '[', '{{') THEN 1 WHEN t IN (')', ']', '}}') THEN -1 ELSE 0 END AS d FROM tokens),
deep AS (SELECT *, sum(d) OVER (PARTITION BY repo, path ORDER BY i) AS depth,
 coalesce(sum(length(t) - length(replace(t, chr(10), ''))) OVER (PARTITION BY repo, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS line FROM placed),
heads AS (SELECT * FROM deep WHERE d = 2),
ends AS (SELECT h.repo, h.path, h.i, min(e.i) FILTER (e.depth < h.depth) AS block, min(e.i) FILTER (e.depth < h.depth - 1) AS whole
 FROM heads h JOIN deep e ON e.repo = h.repo AND e.path = h.path AND e.i > h.i GROUP BY 1, 2, 3),
bodies AS (SELECT h.repo, h.path, h.line, h.t AS head, string_agg(e.t, '' ORDER BY e.i) AS body, coalesce(string_agg(e.t, '' ORDER BY e.i) FILTER (e.i > n.block AND e.i < n.whole), '') AS behind
 FROM heads h JOIN ends n ON n.repo = h.repo AND n.path = h.path AND n.i = h.i JOIN deep e ON e.repo = h.repo AND e.path = h.path AND e.i BETWEEN h.i AND n.whole GROUP BY 1, 2, 3, 4)
SELECT repo, path, CAST(line AS INTEGER) AS line, 'af-webhook-missing-signature' AS rule_id, 'medium' AS severity, 'missing-auth' AS category, 'low' AS confidence
FROM bodies WHERE regexp_matches(regexp_extract(head, '["'']([^"'']*)["'']', 1), '{R.HANDLER_PATH}') AND NOT regexp_matches(body, '{R.HANDLER_CHECKED}') AND trim(behind) IN ('', ',')""",
    ["code_files"],
)
def handler_rule(spark, sf_dir):
    return R.scan_handlers(IN.code_files(spark, sf_dir))


_NOTES = """notes AS (SELECT repo, path, line + 1 AS line, kind, unnest(string_split(replace(ids, ' ', ''), ',')) AS rule_id FROM (
 SELECT repo, path, line, regexp_extract(t, '(?://|#)\\s*(ruleid|ok):', 1) AS kind, regexp_extract(t, '(?:ruleid|ok):\\s*(.+)$', 1) AS ids
 FROM code_lines WHERE regexp_matches(t, '(//|#)\\s*(ruleid|ok):')) AS n)"""
_OUTCOMES = f"""{_RULE_HITS}, {_NOTES},
outcomes AS (SELECT coalesce(n.repo, h.repo) AS repo, coalesce(n.path, h.path) AS path, coalesce(n.line, h.line) AS line, coalesce(n.rule_id, h.rule_id) AS rule_id,
 CASE WHEN n.kind IS NULL THEN 'unannotated' WHEN n.kind = 'ruleid' AND h.repo IS NOT NULL THEN 'TP' WHEN n.kind = 'ruleid' THEN 'FN'
  WHEN h.repo IS NOT NULL THEN 'FP' ELSE 'TN' END AS outcome
 FROM notes n FULL JOIN hits h ON h.repo = n.repo AND h.path = n.path AND h.line = n.line AND h.rule_id = n.rule_id)"""


@query(f"WITH {_OUTCOMES} SELECT repo, path, line, rule_id, outcome FROM outcomes", ["code_files"])
def rule_eval(spark, sf_dir):
    files = IN.code_files(spark, sf_dir)
    return R.evaluate_rules(R.rule_annotations(files), R.scan_rules(files))


@query(
    f"""WITH {_OUTCOMES} SELECT rule_id, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FN') AS fn,
 count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'unannotated') AS unannotated
FROM outcomes GROUP BY rule_id""",
    ["code_files"],
)
def rule_eval_totals(spark, sf_dir):
    files = IN.code_files(spark, sf_dir)
    return R.rule_totals(R.evaluate_rules(R.rule_annotations(files), R.scan_rules(files)))


@query(
    """WITH g AS (SELECT rule_id, count(*) AS n, bool_and(coalesce(severity IN ('critical','high','medium','low'), false)) AS s,
 bool_and(category <> 'misc') AS c, bool_or(has_positive) AS p, bool_or(has_negative) AS q FROM submitted_rules GROUP BY rule_id)
SELECT rule_id, 'duplicate id' AS problem FROM g WHERE n > 1 UNION ALL SELECT rule_id, 'invalid severity' FROM g WHERE NOT s
UNION ALL SELECT rule_id, 'invalid category' FROM g WHERE NOT c UNION ALL SELECT rule_id, 'no positive example' FROM g WHERE NOT p
UNION ALL SELECT rule_id, 'no negative example' FROM g WHERE NOT q""",
    ["submitted_rules"],
)
def rule_catalog_checks(spark, sf_dir):
    rules = IN.load(spark, sf_dir, "submitted_rules")
    examples = rules.select("rule_id", F.explode(F.array_compact(F.array(
        F.when(F.col("has_positive"), F.lit(True)), F.when(F.col("has_negative"), F.lit(False))
    ))).alias("expected"))
    return R.check_catalogue(rules, examples)


# --- secrets ---------------------------------------------------------------

_DETECTOR_ROWS = ",\n".join(f"('{d.name}', '{d.confidence}', {_quote(d.pattern)})" for d in R.SECRET_DETECTORS)


def _secret_check(source: str, key: str, text: str) -> str:
    redact = "CASE WHEN length(m) <= 6 THEN '******' ELSE concat(left(m, 3), '…[redacted, ', CAST(length(m) AS STRING), ' chars]') END"
    return f"""WITH text_lines AS (SELECT {key}, unnest(regexp_split_to_array({text}, '\\r?\\n')) AS t,
 CAST(unnest(range(1, len(regexp_split_to_array({text}, '\\r?\\n')) + 1)) AS INTEGER) AS line FROM {source}),
detectors AS (SELECT * FROM (VALUES {_DETECTOR_ROWS}) AS d(detector, confidence, pattern)),
found AS (SELECT {key}, line, detector, confidence, unnest(regexp_extract_all(t, pattern, 1)) AS m FROM text_lines JOIN detectors ON regexp_matches(t, pattern))
SELECT {key}, line, detector, confidence, CASE WHEN detector = 'private-key' THEN 'critical' ELSE 'high' END AS severity, {redact} AS redacted FROM found"""


@query(_secret_check("documents", "doc_id", "text"))
def secret_scan(spark, sf_dir):
    return R.scan_secrets(IN.load(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(_secret_check("conversations", "conv_id, turn", "text"))
def secret_scan_conversations(spark, sf_dir):
    return R.scan_secrets(IN.load(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


@query(_secret_check("code_files", "repo, path", "content").replace("WITH ", "WITH ", 1), ["code_files"])
def secret_scan_code(spark, sf_dir):
    return R.scan_secrets(IN.code_files(spark, sf_dir), ["repo", "path"])


# --- routes ----------------------------------------------------------------


def _facts(spark, sf_dir):
    return durable(T.route_facts(IN.code_files(spark, sf_dir)))



# Calls on one line, as all of the code files have them.
_ROUTE_RE = _quote(r"""\.(get|post|put|delete|patch|all|head|options)\(\s*['"]([^'"]*)['"]\s*(?:,\s*(.*))?$""")
_USE_RE = _quote(r"""\.use\(\s*(?:['"][^'"]*['"]\s*,\s*)?(.*)$""")
_INLINE_HANDLER = r"(?:async\s*)?(?:function\b|\([^()]*\)\s*=>|\w+\s*=>).*$"


def _guards_sql(rest: str) -> str:
    text = f"regexp_replace({rest}, {_quote(_INLINE_HANDLER)}, '')"
    text = f"regexp_replace({text}, '\\([^()]*\\)', '', 'g')"
    text = f"regexp_replace({text}, '\\)\\s*;?\\s*$', '')"
    return f"[g FOR g IN [regexp_extract(trim(a), '([^.]*)$', 1) FOR a IN string_split({text}, ',')] IF regexp_matches(g, '^[A-Za-z_$][\\w$]*$')]"


_JS_ROUTES = f"""{_CODE_LINES},
js_routes AS (SELECT repo, path AS file, line, 'express' AS framework, upper(regexp_extract(t, {_ROUTE_RE}, 1)) AS method,
 regexp_extract(t, {_ROUTE_RE}, 2) AS route, {_guards_sql(f"regexp_extract(t, {_ROUTE_RE}, 3)")} AS guards
 FROM code_lines WHERE {_JS} AND {_LISTED} AND regexp_matches(t, {_ROUTE_RE}) AND NOT regexp_matches(t, '^\\s*(//|#)')),
global_guards AS (SELECT DISTINCT repo, unnest({_guards_sql(f"regexp_extract(t, {_USE_RE}, 1)")}) AS guard
 FROM code_lines WHERE {_JS} AND {_LISTED} AND contains(t, '.use(') AND NOT regexp_matches(t, '^\\s*(//|#)'))"""


@query(
    f"WITH {_JS_ROUTES} SELECT repo, file, line, framework, method, route, array_to_string(guards, ',') AS guards FROM js_routes",
    ["code_files"],
)
def routes_js(spark, sf_dir):
    return T.js_routes(T.route_facts(IN.code_files(spark, sf_dir))).withColumn("guards", F.array_join("guards", ","))


@query(f"WITH {_JS_ROUTES} SELECT repo, guard FROM global_guards", ["code_files"])
def guards_global(spark, sf_dir):
    return T.global_guards(T.route_facts(IN.code_files(spark, sf_dir), guards_only=True))


# Gaps and islands: a line that is neither decorator, blank nor comment ends a run.
_PY_ROUTES = f"""
pl AS (SELECT repo, path, line, trim(t) AS t FROM code_lines WHERE {_PY} AND {_LISTED} AND trim(t) <> '' AND NOT starts_with(trim(t), '#')),
runs AS (SELECT *, coalesce(sum(CASE WHEN starts_with(t, '@') THEN 0 ELSE 1 END) OVER (PARTITION BY repo, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM pl),
decorated AS (SELECT repo, path, run FROM runs WHERE regexp_matches(t, '^(async\\s+)?def\\s+')),
stacks AS (SELECT r.*, regexp_matches(t, '@\\s*[\\w.]+\\.(route|get|post|put|delete|patch)\\s*\\(') AS is_route FROM runs r
 JOIN decorated d USING (repo, path, run) WHERE starts_with(t, '@')),
first_route AS (SELECT repo, path, run, min(line) FILTER (is_route) AS line FROM stacks GROUP BY 1, 2, 3 HAVING bool_or(is_route)),
py_routes AS (SELECT f.repo, f.path AS file, f.line, 'flask' AS framework,
 max(CASE WHEN s.line = f.line THEN CASE regexp_extract(t, '\\.(route|get|post|put|delete|patch)\\s*\\(', 1) WHEN 'route' THEN 'ANY' ELSE upper(regexp_extract(t, '\\.(route|get|post|put|delete|patch)\\s*\\(', 1)) END END) AS method,
 max(CASE WHEN s.line = f.line THEN regexp_extract(t, '\\(\\s*["'']([^"'']+)["'']', 1) END) AS route,
 coalesce(list(regexp_extract(regexp_extract(t, '@\\s*([\\w.]+)', 1), '([^.]*)$', 1) ORDER BY s.line) FILTER (s.line <> f.line), []) AS guards
 FROM first_route f JOIN stacks s USING (repo, path, run) GROUP BY 1, 2, 3)"""


@query(
    f"WITH {_CODE_LINES}, {_PY_ROUTES} SELECT repo, file, line, framework, method, route, array_to_string(guards, ',') AS guards FROM py_routes",
    ["code_files"],
)
def routes_py(spark, sf_dir):
    return T.py_routes(T.route_facts(IN.code_files(spark, sf_dir))).withColumn("guards", F.array_join("guards", ","))


# Line-wise signals, or-ed per file.
_SIGNALS = f"""
sig AS (SELECT repo, path, t, {_PY} AS is_py, regexp_matches(t, '^\\s*//') AS comment,
 coalesce(nullif(regexp_extract(t, 'require\\(\\s*["'']([^"'']+)["'']', 1), ''), regexp_extract(t, '^\\s*import\\b[^"'']*["'']([^"'']+)["'']', 1)) AS js_module,
 regexp_extract(t, '^\\s*(?:from\\s+([\\w]+)[\\w.]*\\s+import|import\\s+[\\w.]+)', 1) AS py_from, regexp_extract(t, '^\\s*import\\s+(\\w+)', 1) AS py_import
 FROM code_lines WHERE ({_JS} OR {_PY}) AND {_LISTED}),
signals AS (SELECT repo, path,
 bool_or(CASE WHEN is_py THEN regexp_matches(t, '(?i)talisman|secure\\b') ELSE NOT comment AND (regexp_matches(t, '\\bhelmet\\s*\\(') OR js_module = 'helmet' OR regexp_matches(t, '\\.use\\(.*\\bhelmet\\b')) END) AS helmet,
 bool_or(CASE WHEN is_py THEN regexp_matches(t, '(?i)talisman|secure\\b|["'']Content-Security-Policy["'']') ELSE NOT comment AND regexp_matches(t, '(?i)\\.(setHeader|header|set)\\(\\s*["''][^"'']*content-security-policy') END) AS csp,
 bool_or(CASE WHEN is_py THEN regexp_matches(t, '(?i)talisman|secure\\b|["'']Strict-Transport-Security["'']') ELSE NOT comment AND regexp_matches(t, '(?i)\\.(setHeader|header|set)\\(\\s*["''][^"'']*strict-transport-security') END) AS hsts,
 bool_or(CASE WHEN is_py THEN regexp_matches(t, '(?i)flask_limiter|Limiter\\s*\\(|@\\w*limiter\\.limit') ELSE NOT comment AND regexp_matches(js_module, '(?i)(rate-limit|slow-down|rate-limiter-flexible)') END) AS rate_limit,
 bool_or(CASE WHEN is_py THEN regexp_matches(coalesce(nullif(py_from, ''), py_import), '{T.WEB_FRAMEWORK}') ELSE NOT comment AND regexp_matches(js_module, '{T.WEB_FRAMEWORK}') END) AS web_import
 FROM sig GROUP BY 1, 2)"""


@query(f"WITH {_CODE_LINES}, {_SIGNALS} SELECT * FROM signals", ["code_files"])
def file_signals(spark, sf_dir):
    return T.file_signals(T.route_facts(IN.code_files(spark, sf_dir)))


_CFG = T.default_checks()


def _in_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w.lower()}')" for w in words) + ")"


def _in_list(column: str, words: list[str]) -> str:
    return f"(lower({column}) IN ({', '.join(sorted({repr(w.lower()) for w in words}))}))"


_AUTH = f"({_in_list('g', _CFG['authMiddlewareNames'])} OR {_in_any('g', T.V.AUTH_GUARD_WORDS)})"
_LIMIT = _in_list("g", _CFG["rateLimitMiddlewareNames"])
_PROJECT = f"""{_JS_ROUTES}, {_PY_ROUTES}, {_SIGNALS},
all_routes AS (SELECT * FROM js_routes UNION ALL SELECT * FROM py_routes),
guard_flags AS (SELECT repo, bool_or({_AUTH.replace('lower(g)', 'lower(guard)')}) AS auth, bool_or({_LIMIT.replace('lower(g)', 'lower(guard)')}) AS lim, bool_or(guard = 'helmet') AS helmet FROM global_guards GROUP BY repo),
route_flags AS (SELECT repo, bool_or(len([g FOR g IN guards IF {_LIMIT}]) > 0) AS lim, min(file) AS first_file FROM all_routes GROUP BY repo),
signal_flags AS (SELECT repo, bool_or(helmet) AS helmet, bool_or(csp) AS csp, bool_or(hsts) AS hsts, bool_or(rate_limit) AS rate_limit, bool_or(web_import) AS web FROM signals GROUP BY repo),
project AS (SELECT s.repo, s.helmet OR coalesce(g.helmet, false) AS helmet, csp, hsts, s.rate_limit OR coalesce(r.lim, false) OR coalesce(g.lim, false) AS rate_limit,
 s.web OR r.repo IS NOT NULL AS web_app, coalesce(g.auth, false) AS global_auth, r.first_file AS first_route_file
 FROM signal_flags s LEFT JOIN route_flags r USING (repo) LEFT JOIN guard_flags g USING (repo))"""


@query(f"WITH {_PROJECT} SELECT * FROM project", ["code_files"])
def project_flags(spark, sf_dir):
    return T.project_flags(T.route_facts(IN.code_files(spark, sf_dir)))


_FINDING = ["repo", "tool", "rule_id", "severity", "category", "file", "line", "message", "confidence"]


@query(
    f"""WITH {_PROJECT} SELECT r.repo, 'af-auth' AS tool, 'af-missing-auth' AS rule_id, 'high' AS severity, 'missing-auth' AS category, file, line,
 concat('Sensitive route ', method, ' ', route, ' shows no authentication or authorization guard.') AS message, 'medium' AS confidence
FROM all_routes r JOIN project p USING (repo)
WHERE NOT global_auth AND len([g FOR g IN guards IF {_AUTH}]) = 0
 AND ({_in_any('route', _CFG['sensitivePathKeywords'])} OR (method IN ('POST','PUT','DELETE','PATCH') AND regexp_matches(lower(route), '(^|/)api(/|$)')))""",
    ["code_files"],
)
def missing_auth(spark, sf_dir):
    return T.missing_auth(_facts(spark, sf_dir)).select(*_FINDING)


@query(
    f"""WITH {_PROJECT} SELECT r.repo, 'af-rate-limit' AS tool, 'af-missing-rate-limit' AS rule_id, 'medium' AS severity, 'missing-rate-limit' AS category, file, line,
 concat('Login-like route ', method, ' ', route, ' is not rate limited and the app has no limiter, so credentials can be guessed.') AS message, 'medium' AS confidence
FROM all_routes r JOIN project p USING (repo) WHERE NOT rate_limit AND {_in_any('route', _CFG['sensitiveRoutePatterns'])}""",
    ["code_files"],
)
def missing_rate_limit(spark, sf_dir):
    return T.missing_rate_limit(_facts(spark, sf_dir)).select(*_FINDING)


@query(
    f"""WITH {_PROJECT} SELECT repo, 'af-security-headers' AS tool, 'af-missing-security-headers' AS rule_id, 'medium' AS severity, 'missing-security-headers' AS category,
 coalesce(first_route_file, '') AS file, CAST(NULL AS INTEGER) AS line,
 concat('The web app sets no security headers; missing: ', concat_ws(', ', CASE WHEN NOT csp THEN 'Content-Security-Policy' END, CASE WHEN NOT hsts THEN 'Strict-Transport-Security' END), '.') AS message, 'medium' AS confidence
FROM project WHERE web_app AND NOT helmet AND NOT (csp AND hsts)""",
    ["code_files"],
)
def missing_headers(spark, sf_dir):
    return T.missing_headers(_facts(spark, sf_dir)).select(*_FINDING)


def _check_config(spark, sf_dir):
    """The lists that repositories set for themselves, overlaid."""
    rows = IN.load(spark, sf_dir, "check_config")
    user = rows.select("repo", "scope", F.col("name").alias("key"), F.split("val", ",").alias("value"))
    return overlay_config(user, IN.code_files(spark, sf_dir).select("repo"))


_OWN = ["authMiddlewareNames", "sensitivePathKeywords", "sensitiveRoutePatterns"]
_LISTS = "lists AS (SELECT p.repo, " + ", ".join(
    f"string_split(lower(coalesce(max(val) FILTER (name = '{key}'), {_quote(','.join(_CFG[key]))})), ',') AS {key}" for key in _OWN
) + " FROM project p LEFT JOIN check_config c USING (repo) GROUP BY p.repo)"
_OWN_AUTH = f"(list_contains(authMiddlewareNames, lower(g)) OR {_in_any('g', T.V.AUTH_GUARD_WORDS)})"


@query(
    f"""WITH {_PROJECT}, {_LISTS},
covered AS (SELECT DISTINCT repo FROM (SELECT repo, guard AS g FROM global_guards) AS x JOIN lists USING (repo) WHERE {_OWN_AUTH})
SELECT r.repo, file, line, 'af-missing-auth' AS rule_id FROM all_routes r JOIN lists l USING (repo)
WHERE r.repo NOT IN (SELECT repo FROM covered) AND len([g FOR g IN guards IF {_OWN_AUTH}]) = 0
 AND (len([k FOR k IN sensitivePathKeywords IF contains(lower(route), k)]) > 0 OR (method IN ('POST','PUT','DELETE','PATCH') AND regexp_matches(lower(route), '(^|/)api(/|$)')))
UNION ALL SELECT r.repo, file, line, 'af-missing-rate-limit' FROM all_routes r JOIN project p USING (repo) JOIN lists l USING (repo)
WHERE NOT rate_limit AND len([k FOR k IN sensitiveRoutePatterns IF contains(lower(route), k)]) > 0""",
    ["code_files", "check_config"],
)
def checks_configured(spark, sf_dir):
    """The route checks with repositories' own lists."""
    facts = durable(T.with_lists(T.route_facts(IN.code_files(spark, sf_dir)), _check_config(spark, sf_dir)))
    return T.missing_auth(facts).unionByName(T.missing_rate_limit(facts)).select("repo", "file", "line", "rule_id")


# --- taint -----------------------------------------------------------------

# The same line walk as a recursion over line numbers; the state is the list of
# tainted names.
_PY_SRC = _quote(X.V.PY_SOURCE)
_PY_CLEAN = _quote(X.V.PY_SANITIZER)
_SINK_ROWS = ", ".join(f"({i}, {_quote(p)}, '{c}', '{n}')" for i, (p, c, n) in enumerate(X.V.PY_SINKS))
_PY_TAINT = f"""{_CODE_LINES},
py AS (SELECT repo, path, line, CASE WHEN regexp_matches(t, '^\\s*#') THEN '' ELSE t END AS t FROM code_lines WHERE {_PY} AND {_LISTED}),
facts AS (SELECT repo, path, line, t,
 CASE WHEN regexp_matches(t, '{X.PY_ASSIGN}') AND NOT regexp_matches(regexp_replace(t, '^\\s*[A-Za-z_]\\w*\\s*=', ''), '[=!<>]=') THEN regexp_extract(t, '{X.PY_ASSIGN}', 1) END AS var,
 regexp_extract(t, '{X.PY_ASSIGN}', 2) AS rhs FROM py),
walk AS (SELECT repo, path, 0 AS line, CAST([] AS VARCHAR[]) AS tainted FROM (SELECT DISTINCT repo, path FROM py) AS f
 UNION ALL
 SELECT w.repo, w.path, f.line, CASE WHEN var IS NULL THEN tainted WHEN regexp_matches(rhs, {_PY_CLEAN}) THEN [v FOR v IN tainted IF v <> var]
  WHEN (regexp_matches(rhs, {_PY_SRC}) OR list_has_any(regexp_extract_all(rhs, '\\w+'), tainted)) AND NOT list_contains(tainted, var) THEN list_append(tainted, var)
  ELSE tainted END
 FROM walk w JOIN facts f ON f.repo = w.repo AND f.path = w.path AND f.line = w.line + 1),
sinks AS (SELECT * FROM (VALUES {_SINK_ROWS}) AS s(i, pattern, category, sink)),
regions AS (SELECT p.repo, p.path, p.line, sink, category, regexp_extract(regexp_extract(t, concat('(?:', pattern, ').*$'), 0), '\\(.*$', 0) AS region
 FROM py p JOIN sinks s ON regexp_matches(p.t, s.pattern))"""


@query(
    f"""WITH {_PY_TAINT}
SELECT r.repo, r.path AS file, r.line, sink, category,
 CASE WHEN NOT regexp_matches(region, {_PY_SRC}) THEN [v FOR v IN tainted IF list_contains(regexp_extract_all(region, '\\w+'), v)][1] END AS via
FROM regions r JOIN walk w ON w.repo = r.repo AND w.path = r.path AND w.line = r.line
WHERE NOT regexp_matches(region, {_PY_CLEAN}) AND (regexp_matches(region, {_PY_SRC}) OR list_has_any(regexp_extract_all(region, '\\w+'), tainted))""",
    ["code_files"],
    recursive=True,
)
def taint_py(spark, sf_dir):
    return X.py_taint(IN.code_files(spark, sf_dir))


# Known answers per template: the checking SQL says which templates must hit,
# where, and for cross-file flows that the called file exists in the repository.
_CALLED = "p_partkey % 5 <> 0"
_HIT = "concat('repo', CAST(p_partkey - p_partkey % 5 AS STRING)) AS repo, concat('src/m', CAST({key} AS STRING), '.js') AS file, CAST({line} AS INTEGER) AS line"


def _known(template: int, line: int, callee: str, confidence: str, via: str, crossed: bool, key: str = "p_partkey", extra: str = "") -> str:
    return (
        f"SELECT {_HIT.format(key=key, line=line)}, '{callee}' AS callee, '{confidence}' AS confidence, '{via}' AS via, {str(crossed).lower()} AS crossed"
        f" FROM part WHERE p_partkey % 24 = {template}{extra}"
    )


@query(
    " UNION ALL ".join(
        [
            _known(4, 3, "eval", "medium", "req.body", False),
            # the sink file is the one before the calling file
            _known(8, 4, "cp.exec", "low", "text", True, "p_partkey - 1", f" AND {_CALLED}"),
            _known(21, 2, "fs.writeFile", "medium", "name", True, "p_partkey - 1", f" AND {_CALLED}").replace("'medium'", "'low'"),
        ]
    )
)
def taint_js(spark, sf_dir):
    return X.js_taint(IN.code_files(spark, sf_dir)).drop("direct")


@query(
    f"""SELECT concat('repo', CAST(p_partkey - p_partkey % 5 AS STRING)) AS repo, concat('src/m', CAST(p_partkey AS STRING), '.js') AS path,
 concat(CASE WHEN p_partkey % 24 = 19 THEN '../src/./m' ELSE './m' END, CAST(p_partkey - 1 AS STRING)) AS source,
 concat('src/m', CAST(p_partkey - 1 AS STRING), CASE WHEN p_partkey % 24 = 19 THEN '.ts' ELSE '.js' END) AS target
FROM part WHERE p_partkey % 24 IN (8, 19, 21) AND {_CALLED}"""
)
def import_resolution(spark, sf_dir):
    return X.resolve_imports(durable(X.js_models(IN.code_files(spark, sf_dir))))


_EDGE = "concat('repo', CAST(p_partkey - p_partkey % 5 AS STRING)) AS repo, concat('src/m', CAST(p_partkey AS STRING), '.js') AS path, CAST(2 AS INTEGER) AS fn, CAST({line} AS INTEGER) AS line, '{callee}' AS callee, '{origin}' AS origin, concat('src/m', CAST(p_partkey - 1 AS STRING), '.js') AS target, CAST({target_fn} AS INTEGER) AS target_fn, '{param}' AS param"


@query(
    " UNION ALL ".join(
        f"SELECT {_EDGE.format(line=line, callee=callee, origin=origin, target_fn=tfn, param=param)} FROM part WHERE p_partkey % 24 = {t} AND {_CALLED}"
        for t, line, callee, tfn, param in [(8, 4, "runCmd", 2, "input"), (21, 3, "store", 1, "name")]
        for origin in ("", "req")
    )
)
def call_edges(spark, sf_dir):
    return X.call_edges(durable(X.js_models(IN.code_files(spark, sf_dir))))


@query(
    """WITH RECURSIVE reached AS (SELECT node FROM (VALUES ('L0_1'), ('L0_2')) AS s(node)
 UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.node WHERE NOT e.sanitized)
SELECT node, node LIKE 'L6_%' AS sink FROM reached""".replace("WITH RECURSIVE", "WITH"),
    ["edges"],
    recursive=True,
)
def taint_reach(spark, sf_dir):
    edges = IN.load(spark, sf_dir, "edges").filter(~F.col("sanitized"))
    seeds = edges.select(F.col("src").alias("node")).filter(F.col("node").isin("L0_1", "L0_2"))
    return X.reach(edges, seeds).withColumn("sink", F.startswith(F.col("node"), F.lit("L6_")))


# --- forms of code ---------------------------------------------------------

# Known answers per template of the code forms.
_FORM = "SELECT concat('repo', CAST(p_partkey - p_partkey % 5 AS STRING)) AS repo, concat('src/f', CAST(p_partkey AS STRING), '{ext}') AS {path}, {rest} FROM part WHERE p_partkey % 6 = {k}"


def _forms(path: str, rows: list[tuple[int, str]]) -> str:
    return " UNION ALL ".join(_FORM.format(ext=".py" if k == 1 else ".js", path=path, rest=rest, k=k) for k, rest in rows)


@query(
    _forms(
        "path",
        [
            (k, f"CAST({line} AS INTEGER) AS line, 'af-{rule}' AS rule_id")
            for k, line, rule in [(0, 2, "insecure-cookie-httponly-false"), (1, 2, "requests-verify-false"), (1, 3, "requests-verify-false"),
                                  (5, 2, "webhook-missing-signature")]
        ],
    )
)
def forms_rules(spark, sf_dir):
    files = IN.load(spark, sf_dir, "code_forms")
    return R.scan_rules(files).unionByName(R.scan_handlers(files)).select("repo", "path", "line", "rule_id")


@query(
    _forms(
        "file",
        [
            (k, f"CAST({line} AS INTEGER) AS line, '{method}' AS method, {route} AS route, '{guards}' AS guards")
            for k, line, method, route, guards in [
                (2, 2, "POST", "concat('/admin/x', CAST(p_partkey % 7 AS STRING))", "handler"), (2, 2, "GET", "'/a'", "h"), (2, 2, "PUT", "'/b'", "guard,h"),
                (3, 2, "GET", "'/shown'", "requireAuth"), (3, 7, "DELETE", "'/one'", ""), (5, 2, "POST", "'/webhook/a'", ""), (5, 3, "POST", "'/webhook/b'", ""),
                (5, 4, "POST", "'/stripe/in'", ""), (5, 6, "POST", "'/github'", ""),
            ]
        ],
    )
)
def forms_routes(spark, sf_dir):
    facts = T.route_facts(IN.load(spark, sf_dir, "code_forms"))
    return T.js_routes(facts).select("repo", "file", "line", "method", "route", F.array_join("guards", ",").alias("guards"))


@query(_forms("file", [(3, "'check' AS guard")]))
def forms_guards(spark, sf_dir):
    facts = T.route_facts(IN.load(spark, sf_dir, "code_forms"))
    return facts.select("repo", "file", F.explode("use_guards").alias("guard"))


@query(
    _forms(
        "file",
        [
            (4, f"CAST({line} AS INTEGER) AS line, '{callee}' AS callee, '{confidence}' AS confidence, '{via}' AS via")
            for line, callee, confidence, via in [(3, "cp.exec", "low", "name"), (9, "db.query", "low", "q"), (12, "eval", "medium", "late"), (13, "eval", "medium", "k")]
        ],
    )
)
def forms_taint(spark, sf_dir):
    return X.js_taint(IN.load(spark, sf_dir, "code_forms")).select("repo", "file", "line", "callee", "confidence", "via")


@query(
    f"""WITH hits AS ({CHECKS["taint_js"]}) SELECT repo, file, line, CASE WHEN callee LIKE '%writeFile' THEN 'path-traversal' ELSE 'injection' END AS category,
 CASE WHEN callee LIKE '%writeFile' THEN 'af-taint.path-traversal' ELSE 'af-taint.injection' END AS rule_id, confidence FROM hits"""
)
def js_taint_categories(spark, sf_dir):
    """Flows as findings: the category follows from what the sink does."""
    return X.js_taint_findings(IN.code_files(spark, sf_dir)).select("repo", "file", "line", "category", "rule_id", "confidence")


_OWN_KEY = "CAST((p_partkey - p_partkey % 5) / 5 AS BIGINT) % 3 = {k} AND p_partkey - p_partkey % 5 IN (SELECT s_suppkey FROM supplier)"


@query(
    f"""WITH hits AS ({CHECKS["taint_js"]}), parts AS (SELECT p_partkey, concat('repo', CAST(p_partkey - p_partkey % 5 AS STRING)) AS repo,
 {_OWN_KEY.format(k=0)} AS first, {_OWN_KEY.format(k=1)} AS second FROM part),
own AS (SELECT DISTINCT repo, first, second FROM parts)
SELECT h.repo, file, line, callee FROM hits h JOIN own o USING (repo)
WHERE NOT ((first AND (callee = 'eval' OR callee LIKE '%writeFile')) OR (second AND callee = 'cp.exec'))""",
)
def taint_configured(spark, sf_dir):
    """Flows with repositories' own sources, sinks and sanitizers."""
    return X.js_taint(IN.code_files(spark, sf_dir), _check_config(spark, sf_dir)).select("repo", "file", "line", "callee")
