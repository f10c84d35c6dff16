"""Queries over reports and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.operators import dedup as D
from auditframe.operators.findings import make_findings
from auditframe.plans import reports as R
from auditframe.plans import scan as C
from auditframe.queries import inputs as IN
from auditframe.queries.finding_queries import _CHAIN, _CHAIN_USES, _COUNTS, _PRINT, _SHOWN, _chain
from auditframe.queries.registry import _CONF, _SEV, CHECKS, query
from auditframe.session import shared_dir, stored
from auditframe.sources.config import read_baseline
from auditframe.streaming import jobs as J

# --- reports ---------------------------------------------------------------

_FINAL = _CHAIN + f", shown AS (SELECT * FROM final WHERE {_SHOWN})"
_ORDER = f"{_SEV} DESC, {_CONF} DESC, file, coalesce(line, 0), tool, rule_id, category, message"


@query(
    _FINAL
    + """, level AS (SELECT *, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM shown)
SELECT repo, rule_id, level, file AS uri, line AS start_line, message, sha1(concat(tool, chr(0), rule_id, chr(0), category, chr(0), file, chr(0), message)) AS fingerprint, agreed AS agreed_tools
FROM level""",
    _CHAIN_USES,
)
def sarif_results(spark, sf_dir):
    """SARIF documents parsed back: every result with the rule its index points at."""
    lines = stored(R.sarif_lines(stored(C.reported(_chain(spark, sf_dir, with_dropped=False, store=True)))))
    entry = lambda section: lines.filter(F.col("section") == section).select("repo", "place", F.ltrim(F.col("text"), F.lit(",")).alias("text"))
    place = "physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>"
    schema = (
        f"ruleIndex int, level string, message struct<text: string>, locations array<struct<{place}>>,"
        " partialFingerprints map<string, string>, properties struct<agreedTools: array<string>>"
    )
    rules = entry(1).select("repo", F.col("place").alias("i"), F.from_json("text", "id string")["id"].alias("rule_id"))
    rows = entry(3).select("repo", F.from_json("text", schema).alias("r"))
    where = F.col("r.locations")[0]["physicalLocation"]
    return rows.join(rules.withColumnRenamed("repo", "of"), (F.col("repo") == F.col("of")) & (F.col("r.ruleIndex") == F.col("i")), "left").select(
        "repo",
        "rule_id",
        F.col("r.level").alias("level"),
        where["artifactLocation"]["uri"].alias("uri"),
        where["region"]["startLine"].alias("start_line"),
        F.col("r.message.text").alias("message"),
        F.element_at("r.partialFingerprints", "auditframe/v1").alias("fingerprint"),
        F.array_join("r.properties.agreedTools", ",").alias("agreed_tools"),
    )


@query(
    _FINAL
    + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) AS pos FROM shown),
firsts AS (SELECT repo, rule_id, min(pos) AS pos FROM placed GROUP BY 1, 2)
SELECT repo, rule_id, CAST(row_number() OVER (PARTITION BY repo ORDER BY pos) - 1 AS INTEGER) AS rule_index FROM firsts""",
    _CHAIN_USES,
)
def sarif_rules(spark, sf_dir):
    """Rule numbering of a repository in order of first use."""
    return R.rule_first_use(C.reported(_chain(spark, sf_dir, with_dropped=False)))


@query(
    _FINAL
    + f"""SELECT repo, {_COUNTS}, bool_or({_SEV} >= 3) AS failed, arg_min(concat(file, ':', coalesce(CAST(line AS STRING), ''), ' ', rule_id, ' ', category), pos) AS worst
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) AS pos FROM shown) AS x GROUP BY repo""",
    _CHAIN_USES,
)
def json_report(spark, sf_dir):
    """JSON documents parsed back: totals, verdict and the first finding in the order of the lines."""
    rows = stored(_chain(spark, sf_dir, store=True))
    lines = stored(R.json_lines(C.reported(rows), C.verdicts(rows, "high"), fail_on="high"))
    finding = "severity string, file string, line int, rule_id string, category string, ai_relevant boolean"
    entries = lines.filter("section = 2").select("repo", "place", F.from_json(F.ltrim(F.col("text"), F.lit(",")), finding).alias("f")).select("repo", "place", "f.*")
    heads = lines.filter("section = 0").select("repo", F.get_json_object(F.concat("text", F.lit("]}")), "$.failed").cast("boolean").alias("failed"))
    label = F.concat(
        F.col("file"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")), F.lit(" "), F.col("rule_id"),
        F.lit(" "), F.col("category"),
    )
    totals = entries.groupBy("repo").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in reversed(V.SEVERITIES)],
        F.count_if("ai_relevant").alias("ai_relevant"),
        F.min_by(label, "place").alias("worst"),
    )
    return totals.join(heads, "repo")


@query(
    _FINAL
    + f"""SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) - 1 AS BIGINT) AS position, severity, confidence, file, line, tool, rule_id, category, message FROM shown""",
    _CHAIN_USES,
)
def report_positions(spark, sf_dir):
    """Every reported finding with its place in its repository's report."""
    shown = R.with_positions(stored(C.reported(_chain(spark, sf_dir, with_dropped=False, store=True))))
    return shown.select("repo", "position", "severity", "confidence", "file", "line", "tool", "rule_id", "category", "message")


@query(
    _FINAL
    + f""", every_repo AS (SELECT * FROM ({CHECKS['fleet_scan']}) AS v), per_category AS (SELECT repo, category, count(*) AS n FROM shown GROUP BY 1, 2)
SELECT e.repo, coalesce(category, '') AS category, coalesce(n, 0) AS n, total, ignored, duplicates_removed, failed FROM every_repo e LEFT JOIN per_category c USING (repo)""",
    _CHAIN_USES,
)
def json_heads(spark, sf_dir):
    """Heads of the JSON documents: every repository's counts per category, of dropped findings and its verdict."""
    shown, verdicts = _with_dropped(spark, sf_dir)
    lines = R.json_lines(shown, verdicts, fail_on="high").filter("section = 0")
    schema = (
        "failed boolean, summary struct<total: bigint, by_category: map<string, bigint>>,"
        " dropped struct<ignored: bigint, duplicates_removed: bigint>"
    )
    heads = lines.select("repo", F.from_json(F.concat("text", F.lit("]}")), schema).alias("h"))
    rows = heads.select("repo", "h", F.explode_outer("h.summary.by_category").alias("category", "n"))
    return rows.select(
        "repo", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("n", F.lit(0)).alias("n"),
        F.col("h.summary.total").alias("total"), F.col("h.dropped.ignored").alias("ignored"),
        F.col("h.dropped.duplicates_removed").alias("duplicates_removed"), F.col("h.failed").alias("failed"),
    )


_AGREED = "CASE WHEN agreed IS NOT NULL AND contains(agreed, ',') THEN concat('{0}', replace(agreed, ',', '{1}'), '{2}') ELSE '' END"
_MD_LINE = (
    "concat('- **[', category, ']** `', file, coalesce(':' || CAST(line AS STRING), ''), '`: ', message, ' _(', tool, ', ', confidence, ' confidence', "
    + _AGREED.format(", agreed: ", "/", "")
    + ", ')_', CASE WHEN ai_relevant THEN ' `ai-codegen`' ELSE '' END)"
)
# One row per repository, those without a reported finding included.
_VERDICTS = f"({CHECKS['fleet_scan']})"
_REFS = """refs AS (SELECT repo, file, line, category, CASE WHEN line IS NULL THEN rule_id END AS issue_rule,
 list_sort(list_distinct(list(concat('https://rules.test/', rule_id)))) AS links FROM kept GROUP BY ALL)"""
_NOTES = "concat_ws(' · ', " + ", ".join(
    f"CASE WHEN {c} > 0 THEN concat(CAST({c} AS STRING), '{text}') END"
    for c, text in [
        ("ai_relevant", " typical of generated code"), ("ignored", " suppressed by ignore lists"),
        ("inline_suppressed", " suppressed in the source"), ("duplicates_removed", " duplicates merged"),
    ]
) + ")"
_MD_HEAD = f"""[ '## Security scan',
 CASE WHEN failed THEN '**Failed**: there are findings of severity `high` or above' ELSE '**Passed**: no finding of severity `high` or above' END,
 concat('**Target:** `', repo, '`'), '### Summary', '| Severity | Count |', '| --- | --- |',
 {", ".join(f"concat('| {s.capitalize()} | ', CAST({s} AS STRING), ' |')" for s in reversed(V.SEVERITIES))},
 concat('| **Total** | **', CAST(total AS STRING), '** |'), CASE WHEN {_NOTES} <> '' THEN concat('_', {_NOTES}, '_') END,
 '### Findings', CASE WHEN total = 0 THEN 'No findings.' END ]"""
_LEVELS = f"levels AS (SELECT repo, severity, {_SEV} AS o, count(*) AS n FROM shown GROUP BY repo, severity)"


def _with_dropped(spark, sf_dir):
    rows = stored(_chain(spark, sf_dir, store=True))
    return C.reported(rows), C.verdicts(rows, "high")


@query(
    _FINAL
    + f""", {_LEVELS}
SELECT repo, {_MD_LINE} AS text FROM shown
UNION ALL SELECT repo, concat('<summary><strong>', upper(left(severity, 1)), substr(severity, 2), '</strong> (', CAST(n AS STRING), ')</summary>') FROM levels
UNION ALL SELECT repo, CASE WHEN o >= 3 THEN '<details open>' ELSE '<details>' END FROM levels
UNION ALL SELECT repo, '</details>' FROM levels UNION ALL SELECT repo, '' FROM levels UNION ALL SELECT repo, '' FROM levels
UNION ALL SELECT repo, text FROM (SELECT repo, unnest({_MD_HEAD}) AS text FROM {_VERDICTS} AS v) AS h WHERE text IS NOT NULL""",
    _CHAIN_USES,
)
def markdown_report(spark, sf_dir):
    """The Markdown report, as lines: head, summary, notes and findings of every repository."""
    shown, verdicts = _with_dropped(spark, sf_dir)
    return R.markdown_lines(shown, verdicts, fail_on="high").select("repo", "text")


@query(
    _FINAL
    + f""", {_LEVELS}, {_REFS}, every_repo AS (SELECT * FROM {_VERDICTS} AS v)
SELECT repo, concat(upper(severity), ' (', CAST(n AS STRING), ')') AS text FROM levels
UNION ALL SELECT repo, concat('  ', upper(severity), ' ', category, '  ', file, coalesce(':' || CAST(line AS STRING), ''), CASE WHEN ai_relevant THEN ' [ai-codegen]' ELSE '' END) FROM shown
UNION ALL SELECT repo, concat('     ', message) FROM shown
UNION ALL SELECT repo, concat('     by ', tool, ', confidence: ', confidence, {_AGREED.format(" (agreed: ", ", ", ")")}) FROM shown
UNION ALL SELECT s.repo, concat('     see: ', array_to_string(links[1:3], ', ')) FROM shown s JOIN refs r ON r.repo = s.repo AND r.file = s.file
 AND r.line IS NOT DISTINCT FROM s.line AND r.category = s.category AND issue_rule IS NOT DISTINCT FROM CASE WHEN s.line IS NULL THEN s.rule_id END
UNION ALL SELECT repo, concat('  ', CAST(total AS STRING), ' findings, ', CAST(critical AS STRING), ' critical, ', CAST(high AS STRING), ' high, ', CAST(medium AS STRING), ' medium, ', CAST(low AS STRING), ' low') FROM every_repo
UNION ALL SELECT repo, CASE WHEN failed THEN 'Failed' ELSE 'Passed' END FROM every_repo UNION ALL SELECT repo, 'Summary' FROM every_repo""",
    _CHAIN_USES,
)
def text_report(spark, sf_dir):
    """The console listing, as lines, references included, of every repository."""
    shown, verdicts = _with_dropped(spark, sf_dir)
    return R.text_lines(shown, verdicts).select("repo", "text")


# --- sinks -----------------------------------------------------------------


def _scratch(spark) -> str:
    return os.path.join(shared_dir(spark), f"out-{uuid.uuid4().hex}")


@query(f"SELECT DISTINCT repo, {_PRINT} AS fingerprint FROM norm", ["norm"])
def baseline_file(spark, sf_dir):
    """Baseline written and read back."""
    path = _scratch(spark)
    C.write_baseline(IN.findings(spark, sf_dir), path)
    return read_baseline(spark, path)


@query("SELECT repo, file, line, category, tool, rule_id, severity, message FROM merged", ["merged"])
def findings_table(spark, sf_dir):
    """Merged findings written as a table of one run date and read back."""
    path = _scratch(spark)
    C.write_findings(D.dedup(IN.findings(spark, sf_dir)), path, "2024-01-31")
    table = spark.read.parquet(path).filter(F.col("run_date") == "2024-01-31")
    return table.select("repo", "file", "line", "category", "tool", "rule_id", "severity", "message")


# --- streams ---------------------------------------------------------------

_EVENT_RULE = "concat('rule-', event_type)"
_EVENT_FILE = "concat('src/u', CAST(user_id % 40 AS STRING), '.py')"
_EVENT_SEV = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END"
_EVENT_REPO = "concat('repo', CAST(user_id % 7 AS STRING))"


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream of files, be the table one file or a folder of them."""
    path = f"{sf_dir}/events.parquet"
    given = spark.read.parquet(path)
    stream = spark.readStream.schema(given.schema)
    if os.path.basename(os.path.dirname(given.inputFiles()[0])) == "events.parquet":
        return stream.parquet(path)
    return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _as_findings(events: DataFrame) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return make_findings(
        rows, ["ts"], repo=F.expr(_EVENT_REPO), tool=F.lit("bandit"), rule_id=F.expr(_EVENT_RULE),
        severity=F.expr(_EVENT_SEV), category=F.lit("injection"), file=F.expr(_EVENT_FILE),
        line=F.expr("event_id % 3"), message=F.col("event_type"), confidence=F.lit("high"),
    )


def _event_findings(spark, sf_dir, streaming: bool = True) -> DataFrame:
    """Events as findings with a time; read as a stream of files."""
    return _as_findings(_event_stream(spark, sf_dir) if streaming else spark.read.parquet(f"{sf_dir}/events.parquet"))


def _finish(job) -> None:
    job.awaitTermination()
    if job.exception() is not None:
        raise job.exception()


def _run(spark, stream: DataFrame) -> DataFrame:
    out, state = _scratch(spark), _scratch(spark)
    _finish(J.run_to_files(stream, out, state))
    return spark.read.schema(stream.schema).parquet(out)


@query(
    f"""SELECT DISTINCT {_EVENT_REPO} AS repo, CASE WHEN event_id % 3 = 0 THEN concat({_EVENT_FILE}, '::*::injection::', {_EVENT_RULE})
 ELSE concat({_EVENT_FILE}, '::', CAST(event_id % 3 AS STRING), '::injection') END AS issue FROM events"""
)
def stream_dedup(spark, sf_dir):
    """Each issue once, while the watermark (longer than the data) remembers it."""
    rows = J.drop_repeats(_event_findings(spark, sf_dir), delay="60 days")
    return _run(spark, rows.select("repo", "issue"))


_EVENT_PRINT = f"sha1(concat('bandit', chr(0), {_EVENT_RULE}, chr(0), 'injection', chr(0), {_EVENT_FILE}, chr(0), event_type))"


@query(
    f"""WITH old AS (SELECT DISTINCT {_EVENT_REPO} AS repo, {_EVENT_PRINT} AS fingerprint FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00'),
fresh AS (SELECT *, {_EVENT_REPO} AS repo, {_EVENT_PRINT} AS fingerprint FROM events),
kept AS (SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.repo = f.repo AND old.fingerprint = f.fingerprint)),
limits AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM kept)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, repo, count(*) AS new_findings, bool_or(event_type = 'error') AS failed
FROM kept, limits WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2"""
)
def stream_gate(spark, sf_dir):
    """Gate per hour and repository over findings that the first two days did not have.

    Windows appear once the watermark has passed them; the checking SQL leaves
    out the last, still open ones.
    """
    batch = _event_findings(spark, sf_dir, streaming=False)
    baseline = D.build_baseline(batch.filter(F.col("ts") < F.lit("2024-01-03 00:00:00").cast("timestamp")))
    gate = J.windowed_gate(_event_findings(spark, sf_dir), baseline)
    out = _run(spark, gate)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


_TOOLS = ["semgrep", "eslint", "bandit", "gitleaks", "trufflehog", "npm-audit", "pip-audit", "trivy"]
#: What each tool's payload below says, in the order of ``_TOOLS``: rule, severity, category, message.
_SAID = [
    ("concat('rule.', event_type)", "high", "injection", "event_type"),
    ("'security/detect-eval-with-expression'", "high", "injection", "event_type"),
    ("concat('B102 (', event_type, ')')", "high", "injection", "event_type"),
    ("event_type", "high", "secrets", "concat(event_type, '.')"),
    ("concat('trufflehog.', event_type)", "critical", "secrets", "concat('Confirmed ', event_type, ' secret (***).')"),
    ("concat('npm-audit.', event_type)", "low", "dependency-cve", "concat('Package \"', event_type, '\" is vulnerable.')"),
    ("'PYSEC-1'", "medium", "dependency-cve", "concat('PYSEC-1 affects \"', event_type, '\" 1.')"),
    ("'DS002'", "medium", "iac-misconfig", "concat(event_type, ': m')"),
]


@query(
    " UNION ALL ".join(
        f"SELECT concat('repo', CAST(user_id AS STRING)) AS repo, '{tool}' AS tool, {rule} AS rule_id, '{severity}' AS severity,"
        f" '{category}' AS category, {message} AS message FROM events WHERE event_id % 8 = {n}"
        for n, (tool, (rule, severity, category, message)) in enumerate(zip(_TOOLS, _SAID, strict=True))
    )
)
def stream_reports(spark, sf_dir):
    """A stream of report payloads of all eight tools through the batch readers, one source for all of them."""
    t = F.col("event_type")
    lit = lambda **texts: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in texts.items()])
    extra = F.struct(t.alias("message"), F.lit("ERROR").alias("severity"), lit(category="injection").alias("metadata"))
    payloads = [
        F.struct(F.array(lit(check_id=F.concat(F.lit("rule."), t), path="a.py", extra=extra)).alias("results")),
        F.array(lit(filePath="a.js", messages=F.array(lit(ruleId="security/detect-eval-with-expression", message=t)))),
        F.struct(F.array(lit(test_id="B102", test_name=t, issue_text=t, issue_severity="HIGH")).alias("results")),
        F.array(lit(RuleID=t, File="a.env", Description=t)),
        lit(DetectorName=t, Verified="true", Redacted="***"),
        F.struct(F.create_map(t, F.struct(F.lit("low").alias("severity"), F.array().cast("array<string>").alias("via"))).alias("vulnerabilities")),
        F.struct(F.array(lit(name=t, version="1", vulns=F.array(lit(id="PYSEC-1", severity="medium")))).alias("dependencies")),
        F.struct(F.array(lit(Target="x", Misconfigurations=F.array(lit(ID="DS002", Severity="MEDIUM", Title=t, Message="m")))).alias("Results")),
    ]
    kind = F.col("event_id") % 8
    payload, tool = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, made in enumerate(payloads):
        payload, tool = F.when(kind == n, F.to_json(made)).otherwise(payload), F.when(kind == n, F.lit(_TOOLS[n])).otherwise(tool)
    events = _event_stream(spark, sf_dir)
    reports = events.select(F.concat(F.lit("repo"), F.col("user_id")).alias("repo"), tool.alias("tool"), payload.alias("payload"))
    out = _scratch(spark)
    _finish(J.reports_to_files(reports, out, _scratch(spark)))
    return spark.read.parquet(out).select("repo", "tool", "rule_id", "severity", "category", "message")


def _parts(spark, sf_dir) -> list[DataFrame]:
    """The events in four parts by time, so that a stream of them has several triggers."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(4))
    return [events.filter(part == n) for n in range(4)]


@query(
    f"""SELECT repo, issue, list_value('low', 'medium', 'high', 'critical')[max(o)] AS severity FROM (
 SELECT {_EVENT_REPO} AS repo, CASE WHEN event_id % 3 = 0 THEN concat({_EVENT_FILE}, '::*::injection::', {_EVENT_RULE})
  ELSE concat({_EVENT_FILE}, '::', CAST(event_id % 3 AS STRING), '::injection') END AS issue,
  CASE {_EVENT_SEV} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS o FROM events) AS e GROUP BY 1, 2"""
)
def stream_escalations(spark, sf_dir):
    """The standing of every issue after four triggers: the severity of its last row, which is that of the batch."""
    folder = _scratch(spark)
    for part in _parts(spark, sf_dir):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = J.escalations(_as_findings(stream), delay="60 days")
    out = _run(spark, rows)
    worst = F.max(S.severity_ord("severity"))
    return out.groupBy("repo", "issue").agg(S.severity_name(worst).alias("severity"))


@query(
    f"""SELECT repo, count(DISTINCT fingerprint) AS new_findings, bool_or(event_type = 'error') AS failed FROM (
 SELECT {_EVENT_REPO} AS repo, {_EVENT_PRINT} AS fingerprint, event_type FROM events) AS e GROUP BY repo"""
)
def stream_baseline(spark, sf_dir):
    """A baseline fed by four triggers, restarted after two; all gates together."""
    folder, out, state = _scratch(spark), _scratch(spark), _scratch(spark)
    parts = _parts(spark, sf_dir)
    for some in (parts[:2], parts[2:]):
        for part in some:
            part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
        _finish(J.feed_baseline(_as_findings(stream), out, state))
    gates = J.batch_gates(spark.read.parquet(out))
    return gates.groupBy("repo").agg(F.sum("new_findings").alias("new_findings"), F.bool_or("failed").alias("failed"))
