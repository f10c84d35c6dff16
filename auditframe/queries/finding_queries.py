"""Queries over normalised findings: coercion, filters, suppression, merge, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.operators import dedup as D
from auditframe.operators import filters as P
from auditframe.operators import inline as L
from auditframe.operators import summary as M
from auditframe.operators import suppress as U
from auditframe.operators.findings import make_findings
from auditframe.plans import scan as C
from auditframe.queries import inputs as IN
from auditframe.queries.registry import _SEV, conf, dedup_of, query, sev, vendored
from auditframe.sources.config import overlay_config

_CORE = ["repo", "tool", "rule_id", "severity", "category", "file", "line", "message", "confidence", "ai_relevant"]
_CORE_SQL = ", ".join(_CORE)


# --- scalar functions ------------------------------------------------------


@query(
    r"""
SELECT repo_key, seq, repo, tool, rule_id,
 CASE WHEN lower(severity_raw) IN ('critical','high','medium','low') THEN lower(severity_raw) ELSE 'medium' END AS severity,
 CASE WHEN category_raw IN ('injection','secrets','dependency-cve','insecure-jwt','cors-misconfig') THEN category_raw ELSE 'other' END AS category,
 regexp_replace(replace(file_raw, '\', '/'), '^\./', '') AS file,
 CASE WHEN try_cast(line_raw AS DOUBLE) > 0 THEN CAST(floor(try_cast(line_raw AS DOUBLE)) AS INTEGER) END AS line,
 trim(message_raw) AS message,
 CASE WHEN lower(confidence_raw) IN ('high','medium','low') THEN lower(confidence_raw) ELSE 'high' END AS confidence,
 ai_relevant FROM findings_raw""",
    ["findings_raw"],
)
def normalize_findings(spark, sf_dir):
    raw = IN.load(spark, sf_dir, "findings_raw")
    out = make_findings(
        raw, ["repo_key", "seq"], repo="repo", tool="tool", rule_id="rule_id", severity="severity_raw",
        category="category_raw", file="file_raw", line="line_raw", message="message_raw",
        confidence="confidence_raw", ai_relevant="ai_relevant",
    )
    return out.select("repo_key", "seq", *_CORE)


@query(
    """SELECT severity_raw, CASE lower(trim(severity_raw)) WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'error' THEN 'high'
 WHEN 'moderate' THEN 'medium' WHEN 'warn' THEN 'medium' WHEN 'info' THEN 'low' ELSE 'low' END AS severity, count(*) AS n
FROM findings_raw GROUP BY 1, 2""",
    ["findings_raw"],
)
def severity_spellings(spark, sf_dir):
    raw = IN.load(spark, sf_dir, "findings_raw")
    return raw.groupBy("severity_raw", S.normalize_severity("severity_raw", "low").alias("severity")).agg(
        F.count("*").alias("n")
    )


_PHRASES = [
    "Cookie flag", "CORS open", "jws", "SQLi here", "server-side request", "path traversal", "yaml.load",
    "weak hash", "TLS off", "api-key", "CVE-2024-1", "stack trace", "k8s", "xss", "nothing", "",
]
_PHRASE_SQL = "CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END"
_CATEGORY_CASE = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{c}'" for p, c in V.CATEGORY_PATTERNS)


@query(
    f"""SELECT doc_id, CASE {_CATEGORY_CASE} ELSE 'other' END AS category
FROM (SELECT doc_id, lower(concat({_PHRASE_SQL}, ' ', text)) AS t FROM documents) AS d"""
)
def infer_category(spark, sf_dir):
    docs = IN.load(spark, sf_dir, "documents")
    text = F.lower(F.concat(F.expr(_PHRASE_SQL), F.lit(" "), F.col("text")))
    return docs.select("doc_id", text.alias("lowered")).select("doc_id", S.infer_category("lowered").alias("category"))


_REDACT = "CASE WHEN length({c}) = 0 THEN '[redacted]' WHEN length({c}) <= 6 THEN '******' ELSE concat(left({c}, 3), '…[redacted, ', length({c}), ' chars]') END"


@query(
    f"SELECT doc_id, {_REDACT.format(c='text')} AS text_redacted, {_REDACT.format(c='source')} AS source_redacted,"
    f" {_REDACT.format(c='lang')} AS lang_redacted FROM documents"
)
def redact_values(spark, sf_dir):
    docs = IN.load(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", *[S.redact(c).alias(f"{c}_redacted") for c in ("text", "source", "lang")]
    )


_LINK = (
    "CASE WHEN lower({c}) LIKE 'cve-%' THEN concat('https://nvd.nist.gov/vuln/detail/', {c})"
    " WHEN regexp_matches(lower({c}), '^(pysec|ghsa|osv)-') THEN concat('https://osv.dev/vulnerability/', {c}) END"
)


@query(
    f"SELECT part_key, concat_ws('|', {_LINK.format(c='id')}, {_LINK.format(c='alias')}) AS links,"
    " nullif(regexp_extract(url, '(?i)GHSA-[0-9a-z-]+', 0), '') AS ghsa FROM advisories",
    ["advisories"],
)
def advisory_refs(spark, sf_dir):
    rows = IN.load(spark, sf_dir, "advisories")
    links = S.advisory_links("id", F.array("alias"))
    return rows.select("part_key", F.array_join(links, "|").alias("links"), S.ghsa_id("url").alias("ghsa"))


@query(
    f"""SELECT file, {vendored()} AS vendored,
 regexp_matches(lower(file), '[^/]\\.(csv|tsv|psv|parquet|db|jsonl|dat|data)$') AS data_file,
 (list_has_any(string_split(lower(file), '/'), ['test','tests','__tests__','spec','specs'])
  OR regexp_matches(lower(file), '(^|/)(test_[^/]+\\.py|[^/]*_test\\.py|conftest\\.py|[^/]*\\.(test|spec)\\.[cm]?[jt]sx?)$')) AS test_file,
 count(*) AS n FROM norm GROUP BY 1, 2, 3, 4""",
    ["norm"],
)
def path_classes(spark, sf_dir):
    rows = IN.findings(spark, sf_dir)
    return rows.groupBy(
        "file",
        S.is_vendored("file").alias("vendored"),
        S.is_data_file("file").alias("data_file"),
        S.is_test_file("file").alias("test_file"),
    ).agg(F.count("*").alias("n"))


@query(
    """SELECT repo_key, seq, sha1(concat(tool, chr(0), rule_id, chr(0), category, chr(0), file, chr(0), message)) AS fingerprint,
 CASE WHEN line IS NOT NULL THEN concat(file, '::', line, '::', category) ELSE concat(file, '::*::', category, '::', rule_id) END AS issue_key
FROM norm""",
    ["norm"],
)
def finding_keys(spark, sf_dir):
    rows = IN.findings(spark, sf_dir, ["repo_key", "seq"])
    return rows.select("repo_key", "seq", S.fingerprint().alias("fingerprint"), S.dedup_key().alias("issue_key"))


# --- filters ---------------------------------------------------------------


@query(f"SELECT {_CORE_SQL} FROM norm WHERE NOT {vendored()}", ["norm"])
def vendored_filter(spark, sf_dir):
    return P.drop_vendored(IN.findings(spark, sf_dir)).select(*_CORE)


_UNSURE = "(category = 'secrets' AND severity <> 'critical' AND confidence <> 'high' AND file LIKE '%_.csv')"


@query(
    f"""SELECT repo, tool, rule_id, CASE WHEN {_UNSURE} THEN 'low' ELSE severity END AS severity, category, file, line, message,
 CASE WHEN {_UNSURE} THEN 'low' ELSE confidence END AS confidence, ai_relevant,
 CASE WHEN {_UNSURE} THEN 'data-file' END AS demoted_reason FROM norm""",
    ["norm"],
)
def datafile_policy_demote(spark, sf_dir):
    return P.apply_data_file_policy(IN.findings(spark, sf_dir)).select(*_CORE, "demoted_reason")


@query(f"SELECT {_CORE_SQL} FROM norm WHERE NOT {_UNSURE}", ["norm"])
def datafile_policy_ignore(spark, sf_dir):
    return P.apply_data_file_policy(IN.findings(spark, sf_dir), "ignore").select(*_CORE)


# Folders and file names of tests, as paths in lower case.
_TEST_FOLDERS = "'test', 'tests', '__tests__', 'spec', 'specs'"
_TEST_NAMES = r"^test_.+\.py$|_test\.py$|^conftest\.py$|\.(test|spec)\.[cm]?[jt]sx?$"
_PATH = "string_split(lower(replace(coalesce(file, ''), chr(92), '/')), '/')"
_IN_TEST = f"(list_has_any({_PATH}, [{_TEST_FOLDERS}]) OR regexp_matches({_PATH}[-1], '{_TEST_NAMES}'))"
_ASSERT_NOISE = rf"((regexp_matches(rule_id, 'assert_used', 'i') OR regexp_matches(rule_id, '\bB101\b')) AND {_IN_TEST})"


@query(f"SELECT {_CORE_SQL} FROM norm WHERE NOT {_ASSERT_NOISE}", ["norm"])
def test_assert_noise(spark, sf_dir):
    return P.drop_test_asserts(IN.findings(spark, sf_dir)).select(*_CORE)


@query(f"SELECT {_CORE_SQL} FROM norm WHERE confidence IN ('high', 'medium')", ["norm"])
def min_confidence(spark, sf_dir):
    return P.keep_confident(IN.findings(spark, sf_dir), "Medium").select(*_CORE)


# --- ignore lists and directives ------------------------------------------

_ESCAPED = "{c}"
for _ch in "^$.|+()[]{}":
    _ESCAPED = f"replace({_ESCAPED}, '{_ch}', concat(chr(92), '{_ch}'))"
_BODY = "regexp_replace(regexp_replace(regexp_replace(value, '^!', ''), '^/', ''), '/$', '')"
_GLOB = _ESCAPED.replace("{c}", f"replace({_BODY}, chr(92), concat(chr(92), chr(92)))")
for _find, _put in [("**/", "chr(1)"), ("**", "chr(1)"), ("*", "'[^/]*'"), ("?", "'[^/]'"), (None, "'.*'")]:
    _GLOB = f"replace({_GLOB}, {'chr(1)' if _find is None else repr(_find)}, {_put})"
_PATTERNS = f"""
lines AS (SELECT repo, ord, trim(line) AS t FROM ignore_lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
typed AS (SELECT repo, ord, CASE WHEN lower(t) LIKE 'rule:%' THEN 'rule' WHEN lower(t) LIKE 'category:%' THEN 'category' ELSE 'path' END AS kind,
  CASE WHEN lower(t) LIKE 'rule:%' THEN trim(substr(t, 6)) WHEN lower(t) LIKE 'path:%' THEN trim(substr(t, 6))
   WHEN lower(t) LIKE 'category:%' THEN lower(trim(substr(t, 10))) ELSE t END AS value FROM lines),
patterns AS (SELECT repo, ord, kind, value, kind = 'path' AND starts_with(value, '!') AS negated,
  CASE kind WHEN 'path' THEN concat(CASE WHEN regexp_matches(value, '^!?/') OR contains({_BODY}, '/') THEN '^' ELSE '(^|/)' END, {_GLOB}, '(/.*)?$')
   WHEN 'rule' THEN concat('(?i)^', replace({_ESCAPED.replace('{c}', 'value')}, '*', '.*'), '$') END AS regex
 FROM typed WHERE value <> '')
"""


@query(f"WITH {_PATTERNS} SELECT repo, ord, kind, value, regex, negated FROM patterns", ["ignore_lines"])
def ignore_list(spark, sf_dir):
    return U.parse_ignore_lines(IN.load(spark, sf_dir, "ignore_lines"))


_SUPPRESSED = f"""WITH {_PATTERNS},
paths AS (SELECT f.repo, f.file, arg_max(NOT p.negated, p.ord) AS hit
 FROM (SELECT DISTINCT repo, file FROM norm) AS f JOIN patterns p ON p.repo = f.repo AND p.kind = 'path' AND regexp_matches(f.file, p.regex) GROUP BY 1, 2),
rules AS (SELECT DISTINCT f.repo, f.rule_id FROM (SELECT DISTINCT repo, rule_id FROM norm) AS f
 JOIN patterns p ON p.repo = f.repo AND p.kind = 'rule' AND regexp_matches(f.rule_id, p.regex)),
marked AS (SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM patterns p WHERE p.repo = n.repo AND p.kind = 'category' AND p.value = n.category) THEN 'category'
  WHEN r.rule_id IS NOT NULL THEN 'rule' WHEN p.hit THEN 'path' END AS suppressed_by
 FROM norm n LEFT JOIN paths p ON p.repo = n.repo AND p.file = n.file LEFT JOIN rules r ON r.repo = n.repo AND r.rule_id = n.rule_id)
"""


@query(_SUPPRESSED + f"SELECT {_CORE_SQL}, suppressed_by FROM marked", ["norm", "ignore_lines"])
def suppress_globs(spark, sf_dir):
    patterns = U.parse_ignore_lines(IN.load(spark, sf_dir, "ignore_lines"))
    return U.mark_suppressed(IN.findings(spark, sf_dir), patterns).select(*_CORE, "suppressed_by")


_DIRECTIVE = r"(?i)audit-disable(-next-line|-line|-file)?(?:[ \t:]+([^\r\n*]*?))?(?:\s*(?:\*/|-->|$))"
_DIRECTIVES = f"""
src AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n
 FROM files WHERE contains(content, 'audit-disable')),
raw_dirs AS (SELECT repo, path, lower(regexp_extract(t, '{_DIRECTIVE}', 1)) AS scope, n,
  [x FOR x IN regexp_split_to_array(lower(regexp_extract(t, '{_DIRECTIVE}', 2)), '[,\\s]+') IF x <> ''] AS ids
 FROM src WHERE regexp_matches(t, '{_DIRECTIVE}')),
dirs AS (SELECT repo, path, CAST(CASE scope WHEN '-line' THEN n WHEN '-next-line' THEN n + 1 ELSE 0 END AS INTEGER) AS line,
  CASE WHEN len(ids) = 0 THEN NULL ELSE ids END AS ids FROM raw_dirs)
"""


@query(
    f"""WITH files AS (SELECT * FROM code_files UNION ALL SELECT * FROM directive_files), {_DIRECTIVES}
SELECT repo, path, line, CASE WHEN bool_or(ids IS NULL) THEN NULL ELSE array_to_string(list_sort(list_distinct(flatten(list(ids)))), ',') END AS ids
FROM dirs GROUP BY 1, 2, 3""",
    ["code_files", "directive_files"],
)
def inline_directives(spark, sf_dir):
    files = IN.code_files(spark, sf_dir).unionByName(IN.load(spark, sf_dir, "directive_files"))
    return L.merged_directives(files).select("repo", "path", "line", F.array_join("ids", ",").alias("ids"))


@query(
    f"""WITH files AS (SELECT * FROM directive_files), {_DIRECTIVES},
keyed AS (SELECT row_number() OVER () AS k, * FROM norm)
SELECT {_CORE_SQL} FROM keyed n WHERE NOT EXISTS (SELECT 1 FROM dirs d WHERE d.repo = n.repo AND d.path = n.file
 AND (d.line = 0 OR d.line = n.line) AND (d.ids IS NULL OR list_has_any(d.ids, [lower(n.rule_id), lower(n.category), lower(n.tool)])))""",
    ["norm", "directive_files"],
)
def inline_suppress(spark, sf_dir):
    return L.drop_inline_suppressed(IN.findings(spark, sf_dir), IN.load(spark, sf_dir, "directive_files")).select(*_CORE)


# --- merge, counts, gate ---------------------------------------------------

_MERGED = "repo, tool, rule_id, severity, category, file, line, message, confidence, ai_relevant"


@query(f"SELECT {_MERGED}, agreed AS agreed_tools FROM merged", ["merged"])
def dedup_findings(spark, sf_dir):
    out = D.dedup(IN.findings(spark, sf_dir))
    return out.select(*_CORE, F.array_join("agreed_tools", ",").alias("agreed_tools"))


@query("SELECT repo, CAST(sum(n - 1) AS BIGINT) AS duplicates_removed FROM merged GROUP BY repo", ["merged"])
def duplicates_removed(spark, sf_dir):
    return D.duplicates_removed(IN.findings(spark, sf_dir))


_REFS = """SELECT repo, file, line, category, CASE WHEN line IS NULL THEN rule_id END AS issue_rule,
 array_to_string(list_sort(list_distinct(list(concat('https://rules.test/', rule_id)))), '|') AS links, count(*) AS n
FROM norm GROUP BY 1, 2, 3, 4, 5"""


@query(f"SELECT repo, file, line, category, links FROM ({_REFS}) AS r", ["norm"])
def dedup_references(spark, sf_dir):
    out = D.dedup(IN.findings(spark, sf_dir))
    return out.select("repo", "file", "line", "category", F.array_join("references", "|").alias("links"))


_COUNTS = """count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
 count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (ai_relevant) AS ai_relevant"""


@query(f"SELECT repo, {_COUNTS} FROM norm GROUP BY repo", ["norm"])
def summary_severity(spark, sf_dir):
    return M.summarize(IN.findings(spark, sf_dir))


@query("SELECT repo, category, count(*) AS findings FROM norm GROUP BY 1, 2", ["norm"])
def summary_category(spark, sf_dir):
    return M.summarize_categories(IN.findings(spark, sf_dir))


@query("SELECT repo, file, bool_or(severity = 'critical') AS failed FROM norm GROUP BY 1, 2", ["norm"])
def gate(spark, sf_dir):
    return M.gate(IN.findings(spark, sf_dir), "critical", ["repo", "file"])


@query(
    f"""SELECT * FROM (SELECT {_CORE_SQL}, CAST(row_number() OVER (PARTITION BY repo ORDER BY {sev()} DESC, {conf()} DESC, file, coalesce(line, 0), tool, rule_id, category, message) AS INTEGER) AS position
 FROM merged) AS x WHERE position <= 10""",
    ["merged"],
)
def report_order_topn(spark, sf_dir):
    return M.top_findings(D.dedup(IN.findings(spark, sf_dir)), 10).select(*_CORE, "position")


@query(
    f"""SELECT severity, CAST(position AS INTEGER) AS position, {_CORE_SQL.replace('severity, ', '')}
FROM (SELECT *, row_number() OVER (PARTITION BY repo, severity ORDER BY {conf()} DESC, file, coalesce(line, 0), tool, rule_id, category, message) AS position
 FROM merged) AS x WHERE position <= 3""",
    ["merged"],
)
def section_rank(spark, sf_dir):
    return M.top_findings(D.dedup(IN.findings(spark, sf_dir)), 3, ["repo", "severity"]).select(*_CORE, "position")


# --- baseline --------------------------------------------------------------

_PRINT = "sha1(concat(tool, chr(0), rule_id, chr(0), category, chr(0), file, chr(0), message))"


@query(f"SELECT DISTINCT repo, {_PRINT} AS fingerprint FROM merged", ["merged"])
def baseline_build(spark, sf_dir):
    return D.build_baseline(D.dedup(IN.findings(spark, sf_dir)))


def _old_and_all(spark, sf_dir):
    """Baseline from the earlier half of the reports; the current findings are all of them."""
    rows = IN.findings(spark, sf_dir, ["repo_key"])
    old = rows.filter(F.col("repo_key") % 2 == 0).drop("repo_key")
    return D.build_baseline(old), D.dedup(rows.drop("repo_key"))


_OLD = f"old AS (SELECT DISTINCT repo, {_PRINT} AS fingerprint FROM norm WHERE repo_key % 2 = 0)"


@query(
    f"WITH {_OLD} SELECT {_CORE_SQL} FROM merged m WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.repo = m.repo AND old.fingerprint = {_PRINT})",
    ["merged"],
)
def baseline_new(spark, sf_dir):
    baseline, rows = _old_and_all(spark, sf_dir)
    return D.new_findings(rows, baseline).select(*_CORE)


@query(
    f"WITH {_OLD} SELECT {_CORE_SQL} FROM merged m WHERE EXISTS (SELECT 1 FROM old WHERE old.repo = m.repo AND old.fingerprint = {_PRINT})",
    ["merged"],
)
def baseline_known(spark, sf_dir):
    baseline, rows = _old_and_all(spark, sf_dir)
    return D.known_findings(rows, baseline).select(*_CORE)


# --- the whole chain -------------------------------------------------------

_DIR_HIT = """EXISTS (SELECT 1 FROM dirs d WHERE d.repo = m.repo AND d.path = m.file AND (d.line = 0 OR d.line = m.line)
 AND (d.ids IS NULL OR list_has_any(d.ids, [lower(m.rule_id), lower(m.category), lower(m.tool)])))"""
_CHAIN = (
    f"WITH files AS (SELECT * FROM directive_files), {_DIRECTIVES}, "
    + _SUPPRESSED.split("WITH", 1)[1]
    + f""", staged AS (SELECT m.*, CASE WHEN {vendored('m.file')} THEN 'vendored' WHEN suppressed_by IS NOT NULL THEN 'ignored'
  WHEN {_DIR_HIT} THEN 'inline' ELSE 'kept' END AS stage FROM marked m),
kept AS (SELECT * FROM staged WHERE stage = 'kept'),
chain_merged AS ({dedup_of('kept')}),
policy AS (SELECT * REPLACE (CASE WHEN {_UNSURE} THEN 'low' ELSE severity END AS severity, CASE WHEN {_UNSURE} THEN 'low' ELSE confidence END AS confidence),
  {_UNSURE} AS demoted FROM chain_merged),
{_OLD},
final AS (SELECT p.*, CASE WHEN {_ASSERT_NOISE} THEN 'test-assert' WHEN confidence NOT IN ('high', 'medium') THEN 'confidence'
  WHEN EXISTS (SELECT 1 FROM old WHERE old.repo = p.repo AND old.fingerprint = {_PRINT}) THEN 'known' END AS dropped_by FROM policy p)
"""
)
_CHAIN_USES = ["norm", "ignore_lines", "directive_files"]


def _chain(spark, sf_dir, **how):
    rows = IN.findings(spark, sf_dir, ["repo_key"])
    baseline = D.build_baseline(rows.filter(F.col("repo_key") % 2 == 0))
    return C.issues(
        rows.drop("repo_key"), IN.load(spark, sf_dir, "ignore_lines"), IN.load(spark, sf_dir, "directive_files"),
        min_confidence="medium", baseline=baseline, **how,
    )


_SHOWN = "dropped_by IS NULL"


_VERDICT_SQL = f""", dropped AS (SELECT repo, count(*) FILTER (stage = 'vendored') AS vendored, count(*) FILTER (stage = 'ignored') AS ignored,
 count(*) FILTER (stage = 'inline') AS inline_suppressed FROM staged GROUP BY repo),
shown AS (SELECT repo, count(*) FILTER ({_SHOWN}) AS total, count(*) FILTER ({_SHOWN} AND severity = 'critical') AS critical,
 count(*) FILTER ({_SHOWN} AND severity = 'high') AS high, count(*) FILTER ({_SHOWN} AND severity = 'medium') AS medium,
 count(*) FILTER ({_SHOWN} AND severity = 'low') AS low, count(*) FILTER ({_SHOWN} AND ai_relevant) AS ai_relevant,
 CAST(sum(n - 1) AS BIGINT) AS duplicates_removed, count(*) FILTER (demoted) AS demoted,
 count(*) FILTER (dropped_by = 'test-assert') AS test_asserts, count(*) FILTER (dropped_by = 'confidence') AS below_confidence,
 count(*) FILTER (dropped_by = 'known') AS known, bool_or({_SHOWN} AND {_SEV} >= 3) AS failed FROM final GROUP BY repo)
SELECT d.repo, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
 coalesce(low, 0) AS low, coalesce(ai_relevant, 0) AS ai_relevant, vendored, ignored, inline_suppressed,
 coalesce(duplicates_removed, 0) AS duplicates_removed, coalesce(demoted, 0) AS demoted, CAST(0 AS BIGINT) AS data_ignored,
 coalesce(test_asserts, 0) AS test_asserts, coalesce(below_confidence, 0) AS below_confidence, coalesce(known, 0) AS known,
 coalesce(failed, false) AS failed
FROM dropped d LEFT JOIN shown s ON s.repo = d.repo"""


@query(_CHAIN + _VERDICT_SQL, _CHAIN_USES)
def fleet_scan(spark, sf_dir):
    """Flagship: raw findings to one verdict per repository, through every step."""
    return C.verdicts(_chain(spark, sf_dir), "high")


# The chain with the settings of every repository in place of one for all.
_VALID = "NOT (scope = '' AND name = 'failOn' AND lower(val) NOT IN ('critical', 'high', 'medium', 'low'))"
_DEMOTES = f"({_UNSURE} AND data_files NOT IN ('ignore', 'keep'))"
_CONFIGURED = (
    f"""WITH settings AS (SELECT repo, max(lower(val)) FILTER (scope = '' AND name = 'failOn') AS fail_on,
  max(lower(val)) FILTER (scope = 'secrets' AND name = 'dataFiles') AS data_files FROM user_config WHERE {_VALID} GROUP BY repo),
all_lines AS (SELECT repo, ord, line FROM ignore_lines UNION ALL
 SELECT repo, CAST(1073741824 + i AS INTEGER), l FROM (SELECT repo, unnest(string_split(val, ',')) AS l, unnest(range(len(string_split(val, ',')))) AS i
  FROM user_config WHERE scope = '' AND name = 'ignore') AS x), """
    + _CHAIN.split("WITH", 1)[1].replace("ignore_lines", "all_lines").replace(_UNSURE, _DEMOTES)
    .replace("FROM chain_merged)", """FROM (SELECT m.*, coalesce(x.data_files, 'demote') AS data_files, coalesce(x.fail_on, 'critical') AS fail_on
  FROM chain_merged m LEFT JOIN settings x ON x.repo = m.repo) AS chain_set)""")
    .replace(f"CASE WHEN {_ASSERT_NOISE}", f"CASE WHEN {_UNSURE} AND data_files = 'ignore' THEN 'data-file' WHEN {_ASSERT_NOISE}")
)


@query(
    _CONFIGURED
    + _VERDICT_SQL.replace("CAST(0 AS BIGINT) AS data_ignored", "coalesce(data_ignored, 0) AS data_ignored")
    .replace(f"bool_or({_SHOWN} AND {_SEV} >= 3)", f"""count(*) FILTER (dropped_by = 'data-file') AS data_ignored,
 bool_or({_SHOWN} AND {_SEV} >= CASE fail_on WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)"""),
    [*_CHAIN_USES, "user_config"],
)
def fleet_scan_configured(spark, sf_dir):
    """The whole chain with threshold, data-file policy and ignore lines of every repository's own."""
    rows = IN.findings(spark, sf_dir, ["repo_key"])
    baseline = D.build_baseline(rows.filter(F.col("repo_key") % 2 == 0))
    user = IN.load(spark, sf_dir, "user_config").select(
        "repo", "scope", F.col("name").alias("key"), F.split("val", ",").alias("value")
    )
    config = overlay_config(user, user.select("repo"))
    found = C.issues(
        rows.drop("repo_key"), IN.load(spark, sf_dir, "ignore_lines"), IN.load(spark, sf_dir, "directive_files"),
        min_confidence="medium", baseline=baseline, config=config,
    )
    return C.verdicts(found, config=config)


@query(_CHAIN + f"SELECT {_CORE_SQL}, agreed AS agreed_tools FROM final WHERE {_SHOWN}", _CHAIN_USES)
def reported_findings(spark, sf_dir):
    """The findings a report shows after the whole chain."""
    out = C.reported(_chain(spark, sf_dir, with_dropped=False))
    return out.select(*_CORE, F.array_join("agreed_tools", ",").alias("agreed_tools"))


@query(
    _CHAIN
    + """, dropped AS (SELECT repo, count(*) FILTER (stage = 'vendored') AS vendored, count(*) FILTER (stage = 'ignored') AS ignored,
 count(*) FILTER (stage = 'inline') AS inline_suppressed FROM staged GROUP BY repo),
shown AS (SELECT repo, CAST(sum(n - 1) AS BIGINT) AS duplicates_removed, count(*) FILTER (demoted) AS demoted,
 count(*) FILTER (dropped_by = 'test-assert') AS test_asserts, count(*) FILTER (dropped_by = 'confidence') AS below_confidence,
 count(*) FILTER (dropped_by = 'known') AS known FROM final GROUP BY repo)
SELECT d.repo, vendored, ignored, inline_suppressed, coalesce(duplicates_removed, 0) AS duplicates_removed, coalesce(demoted, 0) AS demoted,
 CAST(0 AS BIGINT) AS data_ignored, coalesce(test_asserts, 0) AS test_asserts, coalesce(below_confidence, 0) AS below_confidence,
 coalesce(known, 0) AS known FROM dropped d LEFT JOIN shown s ON s.repo = d.repo""",
    _CHAIN_USES,
)
def drop_counters(spark, sf_dir):
    return C.drop_counters(_chain(spark, sf_dir))
