"""Queries over sources: listings, lines, JSON lines, configuration, scanner reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.operators import profile as P
from auditframe.operators import summary as M
from auditframe.sources import config as G
from auditframe.sources import files as X
from auditframe.sources import reports as R
from auditframe.queries import inputs as IN
from auditframe.queries.registry import query

# --- files -----------------------------------------------------------------

_UNLISTED = "[" + ",".join(f"'{d}'" for d in V.UNLISTED_DIRS) + "]"


@query(
    f"""SELECT page_id, path, n_bytes FROM (SELECT page_id, concat('pages/', regexp_extract(url, '^https?://([^?#]*)', 1)) AS path,
  CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages) AS p
WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), {_UNLISTED}) AND len(string_split(path, '/')) - 1 <= 3
 AND lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) IN ('.html', '.com', '.org', '.net') AND n_bytes <= 400000"""
)
def file_scan_filter(spark, sf_dir):
    pages = IN.load(spark, sf_dir, "pages")
    files = pages.select(
        "page_id",
        F.concat(F.lit("pages/"), F.regexp_extract("url", "^https?://([^?#]*)", 1)).alias("path"),
        F.octet_length("html").cast("long").alias("n_bytes"),
    )
    return X.list_files(files, extensions=[".HTML", ".com", ".org", ".net"], max_depth=3, max_bytes=V.JS_MAX_BYTES)


@query(
    f"""SELECT repo, path FROM repo_listing
WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), {_UNLISTED})
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 3""",
    ["repo_listing"],
)
def listing_cap(spark, sf_dir):
    """The listing with its per-repository cap, a feature that is off unless asked for."""
    return X.list_files(IN.load(spark, sf_dir, "repo_listing"), max_files=3).select("repo", "path")


@query(
    """SELECT repo, path, regexp_matches(path, '\\.py$') AND NOT list_has_any(string_split(path, '/'), ['node_modules','.git']) AS bandit,
 regexp_matches(lower(path), '\\.(js|ts)$') AND NOT list_has_any(string_split(path, '/'), ['node_modules']) AS eslint
FROM (SELECT repo, path FROM code_files UNION ALL SELECT repo, path FROM repo_listing) AS f""",
    ["code_files", "repo_listing"],
)
def scanner_targets(spark, sf_dir):
    files = IN.code_files(spark, sf_dir).unionByName(IN.load(spark, sf_dir, "repo_listing"))
    return files.select("repo", "path", X.bandit_target().alias("bandit"), X.eslint_target().alias("eslint"))


@query(
    """SELECT doc_id, CAST(n AS INTEGER) AS line, t AS text FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS t,
 unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS n FROM documents) AS d"""
)
def explode_lines(spark, sf_dir):
    return X.lines(IN.load(spark, sf_dir, "documents"), ["doc_id"], "text")


_JSONL = """concat(props, chr(13), chr(10), CASE event_id % 3 WHEN 0 THEN '{"k": ' WHEN 1 THEN '   ' ELSE concat('  {"k": ', CAST(event_id AS STRING), '} ') END, chr(10), chr(10), '{}')"""


@query(
    f"""SELECT event_id, CAST(n AS INTEGER) AS line, json_extract_string(t, '$.k') AS k FROM (
 SELECT event_id, trim(unnest(regexp_split_to_array(payload, '\\r?\\n'))) AS t, unnest(range(1, len(regexp_split_to_array(payload, '\\r?\\n')) + 1)) AS n
 FROM (SELECT event_id, {_JSONL} AS payload FROM events) AS e) AS l WHERE t <> '' AND json_valid(t)"""
)
def jsonl_reader(spark, sf_dir):
    events = IN.load(spark, sf_dir, "events").select("event_id", F.expr(_JSONL).alias("payload"))
    return X.json_lines(events, ["event_id"]).select(
        "event_id", "line", F.get_json_object("record", "$.k").alias("k")
    )


# --- configuration ---------------------------------------------------------

_USER = """SELECT repo, scope, name, val FROM user_config
WHERE NOT (scope = '' AND name = 'failOn' AND lower(val) NOT IN ('critical', 'high', 'medium', 'low'))"""
_DEFAULTS = ", ".join(
    f"('{scope}', '{key}', '{','.join(values)}')" for (scope, key), values in V.DEFAULT_CONFIG.items()
)


def _user_config(spark, sf_dir) -> DataFrame:
    return IN.load(spark, sf_dir, "user_config").select(
        "repo", "scope", F.col("name").alias("key"), F.split("val", ",").alias("value")
    )


@query(
    f"""WITH defaults AS (SELECT * FROM (VALUES {_DEFAULTS}) AS d(scope, name, val)),
usr AS ({_USER}),
base AS (SELECT concat('repo', CAST(s_suppkey AS STRING)) AS repo, scope, name, val FROM supplier, defaults)
SELECT coalesce(b.repo, u.repo) AS repo, coalesce(b.scope, u.scope) AS scope, coalesce(b.name, u.name) AS key,
 coalesce(u.val, b.val) AS value, u.val IS NOT NULL AS overridden
FROM base b FULL JOIN usr u ON u.repo = b.repo AND u.scope = b.scope AND u.name = b.name""",
    ["user_config"],
)
def config_overlay(spark, sf_dir):
    repos = IN.load(spark, sf_dir, "supplier").select(F.concat(F.lit("repo"), F.col("s_suppkey")).alias("repo"))
    out = G.overlay_config(_user_config(spark, sf_dir), repos)
    return out.withColumn("value", F.array_join("value", ","))


_KNOWN = " OR ".join(
    f"(scope = '{scope}' AND name IN ({', '.join(repr(k) for k in keys)}))" for scope, keys in V.KNOWN_CONFIG_KEYS.items()
)


@query(
    f"SELECT repo, scope, name AS key FROM user_config WHERE scope IN ('', 'tools', 'checkers', 'taint', 'secrets') AND NOT ({_KNOWN})",
    ["user_config"],
)
def unknown_keys(spark, sf_dir):
    return G.unknown_keys(_user_config(spark, sf_dir))


# --- scanner reports -------------------------------------------------------
# Payloads are built from the raw findings, one report per row; the checking
# SQL reads the columns they were built from.

_ID = "concat(repo, '/', CAST(repo_key AS STRING), '-', CAST(seq AS STRING))"


def _payloads(spark, sf_dir, tool: str, payload: Column) -> DataFrame:
    raw = IN.load(spark, sf_dir, "findings_raw")
    return raw.select(F.expr(_ID).alias("repo"), F.lit(tool).alias("tool"), payload.alias("payload"))


def _shown(findings: DataFrame) -> DataFrame:
    return findings.select(
        "repo", "tool", "rule_id", "severity", "category", "file", "line", "message", "confidence",
        F.array_join("references", "|").alias("refs"), "remediation",
    )


def _expect(**cols: str) -> str:
    order = ["tool", "rule_id", "severity", "category", "file", "line", "message", "confidence", "refs", "remediation"]
    defaults = {"line": "CAST(NULL AS INTEGER)", "refs": "CAST(NULL AS STRING)", "remediation": "CAST(NULL AS STRING)"}
    return f"SELECT {_ID} AS repo, " + ", ".join(f"{cols.get(c, defaults.get(c))} AS {c}" for c in order)


_FILE = "regexp_replace(replace(file_raw, '\\', '/'), '^\\./', '')"
_LINE = "CASE WHEN try_cast(line_raw AS INTEGER) > 0 THEN try_cast(line_raw AS INTEGER) END"


def _alias_sql(column: str, fallback: str) -> str:
    rows = " ".join(
        f"WHEN lower(trim({column})) IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in V.SEVERITY_ALIASES.items()
    )
    return f"CASE {rows} ELSE '{fallback}' END"


_VALID_CATEGORY = "category_raw IN ('injection','secrets','dependency-cve','insecure-jwt','cors-misconfig')"


@query(
    _expect(
        tool="'semgrep'", rule_id="rule_id",
        severity=f"CASE WHEN seq % 3 = 0 AND severity_raw IS NOT NULL THEN {_alias_sql('severity_raw', 'medium')} WHEN seq % 3 = 1 THEN 'high' ELSE 'low' END",
        category=f"CASE WHEN {_VALID_CATEGORY} THEN category_raw WHEN seq % 2 = 0 THEN 'ssrf' ELSE 'insecure-cookie-flags' END",
        file=_FILE, line=_LINE, message="concat('cookie', trim(message_raw))",
        confidence="CASE WHEN lower(confidence_raw) IN ('high','medium','low') THEN lower(confidence_raw) ELSE 'high' END",
        refs="concat('https://a.test|CWE-', CAST(seq AS STRING))",
        remediation="CASE WHEN seq % 2 = 0 THEN 'Proposed fix: safe()' END",
    )
    + " FROM findings_raw",
    ["findings_raw"],
)
def norm_semgrep(spark, sf_dir):
    third = F.col("seq") % 3
    meta = F.struct(
        F.col("category_raw").alias("af-category"),
        F.when(F.col("seq") % 2 == 0, F.lit("ssrf")).alias("category"),
        F.when(third == 0, F.col("severity_raw")).alias("af-severity"),
        F.col("confidence_raw").alias("confidence"),
        F.array(F.lit("https://a.test")).alias("references"),
        F.array(F.concat(F.lit("CWE-"), F.col("seq"))).alias("cwe"),
    )
    result = F.struct(
        F.col("rule_id").alias("check_id"), F.col("file_raw").alias("path"),
        F.struct(F.col("line_raw").try_cast("int").alias("line"), F.lit(3).alias("col")).alias("start"),
        F.struct(
            F.concat(F.lit("cookie"), F.trim("message_raw")).alias("message"),
            F.when(third == 1, F.lit("ERROR")).otherwise(F.lit("info")).alias("severity"),
            F.when(F.col("seq") % 2 == 0, F.lit("safe()")).alias("fix"),
            meta.alias("metadata"),
        ).alias("extra"),
    )
    raw = IN.load(spark, sf_dir, "findings_raw")
    reports = raw.select(
        F.expr(_ID).alias("repo"), F.lit("semgrep").alias("tool"),
        F.to_json(F.struct(F.lit("1.2").alias("version"), F.array(result).alias("results"))).alias("payload"),
    )
    return _shown(R.read_semgrep(reports))


@query(
    _expect(
        tool="'gitleaks'", rule_id="CASE WHEN seq % 3 = 0 THEN 'private-key' ELSE rule_id END",
        severity="CASE WHEN seq % 3 = 0 THEN 'critical' ELSE 'high' END", category="'secrets'", file=_FILE, line=_LINE,
        message="concat(trim(message_raw), CASE WHEN seq % 2 = 0 THEN concat(' (commit ', left(concat('c0ffee', CAST(repo_key AS STRING), 'aaaaaaaa'), 8), ')') ELSE '' END, '.',"
        " CASE WHEN seq % 4 = 1 THEN '' ELSE concat(' Found: ', left(file_raw, 3), '…[redacted, ', CAST(length(file_raw) AS STRING), ' chars]') END)",
        confidence="'high'", remediation=f"'{R.ROTATE}'",
    )
    + " FROM findings_raw",
    ["findings_raw"],
)
def norm_gitleaks(spark, sf_dir):
    even = F.col("seq") % 2 == 0
    leak = F.struct(
        F.when(F.col("seq") % 3 == 0, F.lit("private-key")).otherwise(F.col("rule_id")).alias("RuleID"),
        F.trim("message_raw").alias("Description"),
        F.when(even, F.col("file_raw")).alias("File"),
        F.when(~even, F.col("file_raw")).alias("file"),
        F.when(even, F.col("line_raw").try_cast("int")).alias("StartLine"),
        F.when(~even, F.col("line_raw").try_cast("int")).alias("startLine"),
        F.when(F.col("seq") % 4 == 1, F.lit("")).otherwise(F.col("file_raw")).alias("Match"),
        F.when(even, F.concat(F.lit("c0ffee"), F.col("repo_key"), F.lit("aaaaaaaa"))).otherwise(F.lit("")).alias("Commit"),
    )
    return _shown(R.read_gitleaks(_payloads(spark, sf_dir, "gitleaks", F.to_json(F.array(leak)))))


@query(
    _expect(
        tool="'trufflehog'", rule_id="concat('trufflehog.', rule_id)",
        severity="CASE WHEN seq % 2 = 0 THEN 'critical' ELSE 'high' END", category="'secrets'", file=_FILE, line=_LINE,
        message="concat(CASE WHEN seq % 2 = 0 THEN 'Confirmed ' ELSE 'Possible ' END, rule_id, ' secret (', CASE WHEN seq % 3 = 0 THEN 'ab**' WHEN length(rule_id) <= 6 THEN '******' ELSE"
        " concat(left(rule_id, 3), '…[redacted, ', CAST(length(rule_id) AS STRING), ' chars]') END, ').')",
        confidence="CASE WHEN seq % 2 = 0 THEN 'high' ELSE 'medium' END", remediation=f"'{R.ROTATE}'",
    )
    + " FROM findings_raw",
    ["findings_raw"],
)
def norm_trufflehog(spark, sf_dir):
    place = F.struct(F.col("file_raw").alias("file"), F.col("line_raw").try_cast("int").alias("line"))
    record = F.struct(
        F.col("rule_id").alias("DetectorName"),
        (F.col("seq") % 2 == 0).alias("Verified"),
        F.col("rule_id").alias("Raw"),
        F.when(F.col("seq") % 3 == 0, F.lit("ab**")).alias("Redacted"),
        F.struct(
            F.struct(
                F.when(F.col("seq") % 3 == 0, place).alias("Filesystem"),
                F.when(F.col("seq") % 3 == 1, place).alias("Git"),
                F.when(F.col("seq") % 3 == 2, place).alias("Directory"),
            ).alias("Data")
        ).alias("SourceMetadata"),
    )
    payload = F.concat(F.lit('{"level": "info", "msg": "start"}\n{broken\n\n  '), F.to_json(record), F.lit("\n"))
    return _shown(R.read_trufflehog(_payloads(spark, sf_dir, "trufflehog", payload)))


_NPM_FIX = (
    "CASE seq % 3 WHEN 0 THEN concat('An update fixes this; review it with npm audit and raise ', rule_id, '.')"
    " WHEN 1 THEN concat('Update to ', rule_id, '@2.0', CASE WHEN repo_key % 2 = 0 THEN ' (major release)' ELSE '' END, '.')"
    " ELSE 'No automatic update exists; read the advisory and look for a patched or other package.' END"
)


@query(
    _expect(
        tool="'npm-audit'", rule_id="concat('GHSA-aa-', CAST(seq AS STRING))", severity=_alias_sql("severity_raw", "medium"),
        category="'dependency-cve'", file="'package.json'",
        message="concat(trim(message_raw), ': package \"', rule_id, '\" (versions <', CAST(seq AS STRING), ').')",
        confidence="'high'", refs="concat('https://x.test/GHSA-aa-', CAST(seq AS STRING))", remediation=_NPM_FIX,
    )
    + " FROM findings_raw UNION ALL "
    + _expect(
        tool="'npm-audit'", rule_id="concat('npm-audit.only-', rule_id)", severity="'low'", category="'dependency-cve'",
        file="'package.json'", message="concat('Package \"only-', rule_id, '\" is vulnerable (versions *).')", confidence="'high'",
        remediation="'No automatic update exists; read the advisory and look for a patched or other package.'",
    )
    + " FROM findings_raw",
    ["findings_raw"],
)
def norm_npm_v7(spark, sf_dir):
    # to_json cannot mix strings and objects in one array, so the list is spliced as text.
    url = F.concat(F.lit("https://x.test/GHSA-aa-"), F.col("seq"))
    advisory = F.to_json(
        F.struct(
            F.trim("message_raw").alias("title"), url.alias("url"), F.col("severity_raw").alias("severity"),
            F.concat(F.lit("<"), F.col("seq")).alias("range"), F.lit(7).alias("source"),
        )
    )
    fix = F.expr(
        """CASE seq % 3 WHEN 0 THEN 'true' WHEN 1 THEN concat('{"name": "', rule_id, '", "version": "2.0", "isSemVerMajor": ', CAST(repo_key % 2 = 0 AS STRING), '}') ELSE 'false' END"""
    )
    payload = F.concat(
        F.lit('{"vulnerabilities": {"'), F.col("rule_id"), F.lit('": {"via": ["dep", '), advisory, F.lit(", "), advisory,
        F.lit('], "fixAvailable": '), fix, F.lit('}, "only-'), F.col("rule_id"),
        F.lit('": {"severity": "info", "range": "*", "via": ["dep"], "fixAvailable": false}}}'),
    )
    return _shown(R.read_npm_v7(_payloads(spark, sf_dir, "npm-audit", payload)))


@query(
    _expect(
        tool="'npm-audit'", rule_id="CASE WHEN seq % 2 = 0 THEN concat('GHSA-', rule_id) ELSE concat('npm-audit.', CAST(repo_key AS STRING)) END",
        severity=_alias_sql("severity_raw", "medium"), category="'dependency-cve'", file="'package.json'",
        message="concat(trim(message_raw), ': package \"', rule_id, '\".')", confidence="'high'", remediation="'raise it'",
    )
    + " FROM findings_raw",
    ["findings_raw"],
)
def norm_npm_v6(spark, sf_dir):
    advisory = F.struct(
        F.col("repo_key").alias("id"),
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit("GHSA-"), F.col("rule_id"))).alias("github_advisory_id"),
        F.col("severity_raw").alias("severity"), F.trim("message_raw").alias("title"), F.col("rule_id").alias("module_name"),
        F.lit("raise it").alias("recommendation"),
    )
    payload = F.to_json(F.struct(F.create_map(F.col("repo_key").cast("string"), advisory).alias("advisories")))
    return _shown(R.read_npm_v6(_payloads(spark, sf_dir, "npm-audit", payload)))


@query(
    _expect(
        tool="'pip-audit'", rule_id="concat('PYSEC-', rule_id)", severity=_alias_sql("severity_raw", "high"),
        category="'dependency-cve'", file="'requirements.txt'",
        message="concat('PYSEC-', rule_id, CASE WHEN seq % 2 = 0 THEN concat(' (CVE-', CAST(seq AS STRING), ', x)') ELSE '' END, ' affects \"', file_raw, '\" 1.0.')",
        confidence="'high'",
        refs="concat('https://osv.dev/vulnerability/PYSEC-', rule_id, CASE WHEN seq % 2 = 0 THEN concat('|https://nvd.nist.gov/vuln/detail/CVE-', CAST(seq AS STRING)) ELSE '' END)",
        remediation="CASE WHEN seq % 2 = 0 THEN concat('Raise \"', file_raw, '\" to 1.1 or 2.0.') ELSE 'No fixed version is listed; the advisory may name a workaround.' END",
    )
    + " FROM findings_raw",
    ["findings_raw"],
)
def norm_pip(spark, sf_dir):
    even = F.col("seq") % 2 == 0
    vuln = F.struct(
        F.concat(F.lit("PYSEC-"), F.col("rule_id")).alias("id"), F.col("severity_raw").alias("severity"),
        F.when(even, F.array(F.lit("1.1"), F.lit("2.0"))).alias("fix_versions"),
        F.when(even, F.array(F.concat(F.lit("CVE-"), F.col("seq")), F.lit("x"))).alias("aliases"),
    )
    dep = F.array(F.struct(F.col("file_raw").alias("name"), F.lit("1.0").alias("version"), F.array(vuln).alias("vulns")))
    payload = F.when(even, F.to_json(dep)).otherwise(F.to_json(F.struct(dep.alias("dependencies"))))
    return _shown(R.read_pip_audit(_payloads(spark, sf_dir, "pip-audit", payload)))


_ESLINT_RULE = "CASE seq % 4 WHEN 0 THEN 'security/detect-child-process' WHEN 1 THEN 'security/detect-new-buffer' WHEN 2 THEN 'no-unsanitized/zzz' ELSE 'no-undef' END"


@query(
    _expect(
        tool="'eslint'", rule_id=_ESLINT_RULE, severity="CASE seq % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END",
        category="CASE seq % 4 WHEN 0 THEN 'injection' ELSE 'other' END", file="concat('lib/', rule_id)", line=_LINE,
        message="trim(message_raw)", confidence="'medium'",
    )
    + " FROM findings_raw WHERE seq % 4 <> 3",
    ["findings_raw"],
)
def norm_eslint(spark, sf_dir):
    def message(rule: Column, fatal: bool) -> Column:
        return F.struct(
            rule.alias("ruleId"), F.lit(fatal).alias("fatal"), F.col("message_raw").alias("message"),
            F.col("line_raw").try_cast("int").alias("line"), F.lit(2).alias("column"),
        )

    result = F.struct(
        F.concat(F.lit("/work/lib/"), F.col("rule_id")).alias("filePath"),
        F.array(message(F.expr(_ESLINT_RULE), False), message(F.lit("security/detect-new-buffer"), True), message(F.lit(None).cast("string"), False)).alias("messages"),
    )
    reports = _payloads(spark, sf_dir, "eslint", F.to_json(F.array(result))).withColumn("root", F.lit("/work"))
    return _shown(R.read_eslint(reports))


@query(
    _expect(
        tool="'bandit'", rule_id="CASE WHEN seq % 4 = 3 THEN 'some_test' ELSE concat('B', CAST(300 + seq AS STRING), ' (some_test)') END",
        severity=_alias_sql("severity_raw", "medium"),
        category="CASE seq % 4 WHEN 3 THEN 'insecure-transport' ELSE CASE seq WHEN 1 THEN 'insecure-deserialization' WHEN 2 THEN 'insecure-deserialization' WHEN 4 THEN 'insecure-crypto' WHEN 5 THEN 'insecure-crypto' WHEN 6 THEN 'insecure-config' END END",
        file=_FILE, line=_LINE, message="concat('TLS', trim(message_raw))",
        confidence="CASE WHEN lower(confidence_raw) IN ('high','medium','low') THEN lower(confidence_raw) ELSE 'medium' END",
        refs="concat('https://b.test', CASE WHEN seq % 2 = 0 THEN '|https://cwe.test' ELSE '' END)",
    )
    + " FROM findings_raw",
    ["findings_raw"],
)
def norm_bandit(spark, sf_dir):
    result = F.struct(
        F.when(F.col("seq") % 4 != 3, F.concat(F.lit("B"), 300 + F.col("seq"))).alias("test_id"),
        F.lit("some_test").alias("test_name"), F.col("file_raw").alias("filename"),
        F.col("severity_raw").alias("issue_severity"), F.col("confidence_raw").alias("issue_confidence"),
        F.concat(F.lit("TLS"), F.trim("message_raw")).alias("issue_text"),
        F.col("line_raw").try_cast("int").alias("line_number"), F.lit("https://b.test").alias("more_info"),
        F.when(F.col("seq") % 2 == 0, F.struct(F.lit("https://cwe.test").alias("link"))).alias("issue_cwe"),
    )
    payload = F.to_json(F.struct(F.array(result).alias("results")))
    return _shown(R.read_bandit(_payloads(spark, sf_dir, "bandit", payload)))


def _trivy(spark, sf_dir, part: str, item: Column) -> DataFrame:
    result = F.struct(F.col("file_raw").alias("Target"), F.array(item).alias(part))
    return _payloads(spark, sf_dir, "trivy", F.to_json(F.struct(F.array(result).alias("Results"))))


@query(
    _expect(
        tool="'trivy'", rule_id="rule_id", severity=_alias_sql("severity_raw", "medium"), category="'dependency-cve'", file=_FILE,
        message="concat(CASE WHEN seq % 2 = 0 THEN trim(message_raw) ELSE rule_id END, ': pkg 1.0.')", confidence="'high'",
        refs="'https://t.test'", remediation="CASE WHEN seq % 3 = 0 THEN 'Raise pkg to 2.0.' END",
    )
    + " FROM findings_raw",
    ["findings_raw"],
)
def norm_trivy_vulnerabilities(spark, sf_dir):
    item = F.struct(
        F.col("rule_id").alias("VulnerabilityID"), F.col("severity_raw").alias("Severity"),
        F.when(F.col("seq") % 2 == 0, F.trim("message_raw")).alias("Title"), F.lit("pkg").alias("PkgName"),
        F.lit("1.0").alias("InstalledVersion"), F.when(F.col("seq") % 3 == 0, F.lit("2.0")).alias("FixedVersion"),
        F.lit("https://t.test").alias("PrimaryURL"),
    )
    return _shown(R.read_trivy_vulnerabilities(_trivy(spark, sf_dir, "Vulnerabilities", item)))


@query(
    _expect(
        tool="'trivy'", rule_id="CASE WHEN seq % 2 = 0 THEN concat('AVD-', rule_id) ELSE rule_id END",
        severity=_alias_sql("severity_raw", "medium"), category="'iac-misconfig'", file=_FILE, line=_LINE,
        message="concat('Open port: ', trim(message_raw))", confidence="'high'", remediation="'close it'",
    )
    + " FROM findings_raw",
    ["findings_raw"],
)
def norm_trivy_misconfigurations(spark, sf_dir):
    even = F.col("seq") % 2 == 0
    item = F.struct(
        F.when(even, F.concat(F.lit("AVD-"), F.col("rule_id"))).alias("AVDID"), F.col("rule_id").alias("ID"),
        F.col("severity_raw").alias("Severity"), F.lit("Open port").alias("Title"),
        F.when(even, F.col("message_raw")).alias("Message"), F.col("message_raw").alias("Description"),
        F.lit("close it").alias("Resolution"),
        F.struct(F.col("line_raw").try_cast("int").alias("StartLine")).alias("CauseMetadata"),
    )
    item = item.withField("Message", F.when(even, F.trim("message_raw"))).withField("Description", F.trim("message_raw"))
    return _shown(R.read_trivy_misconfigurations(_trivy(spark, sf_dir, "Misconfigurations", item)))


@query(
    _expect(
        tool="'trivy'", rule_id="rule_id", severity=_alias_sql("severity_raw", "high"), category="'secrets'", file=_FILE, line=_LINE,
        message="concat('Key found (', left(file_raw, 3), '…[redacted, ', CAST(length(file_raw) AS STRING), ' chars]).')",
        confidence="'high'", remediation=f"'{R.ROTATE}'",
    )
    + " FROM findings_raw",
    ["findings_raw"],
)
def norm_trivy_secrets(spark, sf_dir):
    item = F.struct(
        F.col("rule_id").alias("RuleID"), F.col("severity_raw").alias("Severity"), F.lit("Key").alias("Category"),
        F.col("file_raw").alias("Match"), F.col("line_raw").try_cast("int").alias("StartLine"),
    )
    return _shown(R.read_trivy_secrets(_trivy(spark, sf_dir, "Secrets", item)))


_TOOL_CASE = "CASE repo_key % 4 WHEN 0 THEN 'bandit' WHEN 1 THEN 'eslint' WHEN 2 THEN 'trufflehog' ELSE 'gitleaks' END"


def _mixed_reports(spark, sf_dir) -> DataFrame:
    """Reports of four scanners; some are broken, failed, late or absent."""
    raw = IN.load(spark, sf_dir, "findings_raw")
    bandit = F.to_json(
        F.struct(F.array(F.struct(F.col("rule_id").alias("test_name"), F.col("file_raw").alias("filename"))).alias("results"))
    )
    lint_message = F.struct(F.lit("security/detect-new-buffer").alias("ruleId"), F.lit("m").alias("message"))
    eslint = F.to_json(F.array(F.struct(F.col("file_raw").alias("filePath"), F.array(lint_message, lint_message).alias("messages"))))
    hog = F.to_json(F.struct(F.col("rule_id").alias("DetectorName")))
    leaks = F.to_json(F.array(F.struct(F.col("rule_id").alias("RuleID"), F.col("file_raw").alias("File"))))
    kind = F.col("repo_key") % 4
    good = F.when(kind == 0, bandit).when(kind == 1, eslint).when(kind == 2, hog).otherwise(leaks)
    return raw.select(
        "repo",
        F.expr(_TOOL_CASE).alias("tool"),
        F.when(F.col("seq") <= 2, F.lit("oops {")).otherwise(good).alias("payload"),
        F.when(F.col("seq") == 1, F.lit(2)).otherwise(F.lit(0)).alias("exit_code"),
        (F.col("rule_id") == "R9").alias("timed_out"),
        (F.col("rule_id") == "R8").alias("not_found"),
        F.concat(F.lit("1."), F.col("seq").cast("string")).alias("version"),
        (F.col("seq") * 10).alias("duration_ms"),
    )


_STATUS = (
    "CASE WHEN rule_id = 'R9' THEN 'timeout' WHEN rule_id = 'R8' THEN 'skipped'"
    f" WHEN seq = 1 AND {_TOOL_CASE} <> 'trufflehog' THEN 'error' ELSE 'ok' END"
)


@query(
    f"""WITH runs AS (SELECT repo, {_TOOL_CASE} AS tool, {_STATUS} AS status, seq,
 CASE WHEN seq <= 2 THEN 0 WHEN repo_key % 4 = 1 THEN 2 ELSE 1 END AS n FROM findings_raw),
ranked AS (SELECT repo, tool, max(CASE status WHEN 'ok' THEN 0 WHEN 'skipped' THEN 1 WHEN 'timeout' THEN 2 ELSE 3 END) AS worst,
 count(*) AS reports, CAST(sum(n) AS BIGINT) AS findings, max(concat('1.', CAST(seq AS STRING))) AS version, CAST(sum(seq * 10) AS BIGINT) AS duration_ms FROM runs GROUP BY 1, 2)
SELECT repo, tool, list_value('ok', 'skipped', 'timeout', 'error')[worst + 1] AS status,
 list_value(NULL, 'not installed', 'timed out', 'exit code 2, unreadable output')[worst + 1] AS reason, reports, findings, version, duration_ms FROM ranked""",
    ["findings_raw"],
)
def analyzer_status(spark, sf_dir):
    reports = _mixed_reports(spark, sf_dir)
    return R.analyzer_status(reports, R.read_reports(reports))


@query(
    """WITH locks AS (SELECT repo, min(path) AS lock FROM repo_listing WHERE regexp_matches(path, '(^|/)package-lock\\.json$') AND NOT contains(path, 'node_modules/') GROUP BY repo)
SELECT repo, regexp_replace(lock, 'package-lock\\.json$', 'package.json') AS manifest FROM locks""",
    ["repo_listing"],
)
def manifest_labels(spark, sf_dir):
    return R.manifest_paths(IN.load(spark, sf_dir, "repo_listing"))


# --- profiles and selection ------------------------------------------------

_SEEN = "(NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), ['node_modules', '.git']))"
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_FLAGS = f"""files AS (SELECT repo, path, content, {_BASE} AS base, {_SEEN} AS seen FROM repo_listing),
flags AS (SELECT repo,
 bool_or(seen AND base = 'package.json') AS node, bool_or(seen AND base IN ('requirements.txt', 'app.py')) AS python,
 bool_or(seen AND base IN ('Dockerfile', 'dev.Dockerfile', 'compose.yml')) AS docker, bool_or(seen AND base = 'main.tf') AS terraform,
 bool_or(seen AND base = 'deploy.yaml') AS kubernetes, bool_or(seen AND base = 'pom.xml') AS java,
 bool_or(seen AND base = 'app.csproj') AS dotnet, bool_or(path LIKE '.git/%') AS git,
 bool_or(seen AND regexp_matches(lower(base), '\\.(py|tf|yaml|yml|ts)$')) AS has_source, bool_or(seen AND base = 'index.TS') AS has_js,
 count(*) FILTER (seen) AS files
 FROM files WHERE seen OR path LIKE '.git/%' GROUP BY repo)
"""
_LANGS = "concat_ws(',', CASE WHEN node OR has_js THEN 'javascript' END, CASE WHEN python THEN 'python' END)"
_TOOLS = """concat_ws(',', CASE WHEN python THEN 'bandit' END, CASE WHEN node THEN 'eslint' END, CASE WHEN git THEN 'gitleaks' END,
 CASE WHEN node THEN 'npm-audit' END, CASE WHEN python THEN 'pip-audit' END, CASE WHEN has_source THEN 'semgrep' END,
 CASE WHEN docker OR terraform OR kubernetes THEN 'trivy' END, CASE WHEN git THEN 'trufflehog' END)"""


@query(
    f"""WITH {_FLAGS} SELECT repo, node, python, docker, terraform, kubernetes, java, dotnet, git, has_source, files,
 {_LANGS} AS languages, {_TOOLS} AS enabled_tools FROM flags""",
    ["repo_listing"],
)
def repo_profile(spark, sf_dir):
    out = P.repo_profile(IN.load(spark, sf_dir, "repo_listing"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("languages", "enabled_tools")})


@query(
    f"""WITH files AS (SELECT repo, path, {_BASE} AS base, {_SEEN} AS seen, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM repo_listing)
SELECT DISTINCT repo, CASE base WHEN 'package.json' THEN 'node' WHEN 'requirements.txt' THEN 'python' WHEN 'app.py' THEN 'python' WHEN 'Dockerfile' THEN 'docker'
  WHEN 'dev.Dockerfile' THEN 'docker' WHEN 'compose.yml' THEN 'docker' WHEN 'main.tf' THEN 'terraform' WHEN 'deploy.yaml' THEN 'kubernetes'
  WHEN 'pom.xml' THEN 'java' ELSE 'dotnet' END AS stack,
 CASE base WHEN 'app.py' THEN concat('*.py (', dir, ')') WHEN 'main.tf' THEN concat('*.tf (', dir, ')') ELSE path END AS marker
FROM files WHERE seen AND base IN ('package.json','requirements.txt','app.py','Dockerfile','dev.Dockerfile','compose.yml','main.tf','deploy.yaml','pom.xml','app.csproj')
UNION SELECT DISTINCT repo, 'git', '.git' FROM files WHERE path LIKE '.git/%'""",
    ["repo_listing"],
)
def repo_markers(spark, sf_dir):
    return P.repo_markers(IN.load(spark, sf_dir, "repo_listing"))


@query(
    "SELECT repo, path, path LIKE '%deploy.yaml' AS manifest FROM repo_listing WHERE regexp_matches(path, '\\.ya?ml$')",
    ["repo_listing"],
)
def k8s_manifests(spark, sf_dir):
    rows = IN.load(spark, sf_dir, "repo_listing").filter(S.extension("path").isin(".yaml", ".yml"))
    return rows.select("repo", "path", P.is_k8s_manifest().alias("manifest"))


@query(
    """WITH found AS (SELECT repo, CASE path WHEN '.nvmrc' THEN 0 WHEN '.node-version' THEN 1 ELSE 2 END AS rank,
  CASE path WHEN 'package.json' THEN json_extract_string(content, '$.engines.node') WHEN '.nvmrc' THEN trim(replace(content, chr(10), ''))
   ELSE regexp_extract(content, '20\\.[0-9]', 0) END AS value
 FROM repo_listing WHERE path IN ('.nvmrc', '.node-version', 'package.json'))
SELECT repo, list_value('.nvmrc', '.node-version', 'package.json engines.node')[CAST(min(rank) AS INTEGER) + 1] AS source,
 arg_min(value, concat(CAST(rank AS STRING), value)) AS value FROM found WHERE value IS NOT NULL GROUP BY repo""",
    ["repo_listing"],
)
def runtime_constraint(spark, sf_dir):
    return P.node_constraint(IN.load(spark, sf_dir, "repo_listing"))


@query(
    f"""WITH {_FLAGS} SELECT repo, unnest(['af-auth', 'af-rate-limit', 'af-security-headers', 'af-taint']) AS "check"
FROM flags WHERE node OR has_js OR python""",
    ["repo_listing"],
)
def applicable_checks(spark, sf_dir):
    return P.applicable_checks(P.repo_profile(IN.load(spark, sf_dir, "repo_listing")))


def _tool_settings(spark, sf_dir) -> DataFrame:
    rows = IN.load(spark, sf_dir, "user_config").filter(F.col("scope") == "tools")
    pick = [F.max(F.when(F.col("name") == n, F.split("val", ","))).alias(n) for n in ("enabled", "disabled")]
    # Settings are keyed by supplier, profiles by part; both start with 'repo'.
    return rows.groupBy("repo").agg(*pick)


@query(
    f"""WITH {_FLAGS},
settings AS (SELECT repo, max(CASE WHEN name = 'enabled' THEN val END) AS enabled, max(CASE WHEN name = 'disabled' THEN val END) AS disabled
 FROM user_config WHERE scope = 'tools' GROUP BY repo),
chosen AS (SELECT f.repo, unnest(string_split(concat_ws(',', CASE WHEN s.enabled IS NULL THEN {_TOOLS} ELSE 'bandit,semgrep' END,
  CASE WHEN node OR has_js OR python THEN 'af-auth,af-rate-limit,af-security-headers,af-taint' END), ',')) AS analyzer, s.disabled
 FROM flags f LEFT JOIN settings s ON s.repo = f.repo)
SELECT repo, analyzer FROM chosen WHERE analyzer <> '' AND analyzer <> 'eslint' AND analyzer IS DISTINCT FROM disabled""",
    ["repo_listing", "user_config"],
)
def select_analyzers(spark, sf_dir):
    profile = P.repo_profile(IN.load(spark, sf_dir, "repo_listing"))
    return M.select_analyzers(profile, _tool_settings(spark, sf_dir), skip=["eslint", "unheard-of"])


@query(
    f"""WITH {_FLAGS} SELECT repo, unnest(['trivy', 'af-taint']) AS analyzer FROM flags""",
    ["repo_listing"],
)
def select_only(spark, sf_dir):
    profile = P.repo_profile(IN.load(spark, sf_dir, "repo_listing"))
    return M.select_analyzers(profile, only=["af-taint", "trivy", "unheard-of"])
