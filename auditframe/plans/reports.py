"""Reports per repository: JSON, SARIF 2.1.0, Markdown and plain text.

A repository may hold a large part of all findings, so no report is built from
a whole repository at once. Every report is a table of ordered lines, written with
a range-partitioned sort; the lines of a repository, one after the other, are one
complete document in report order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.operators.profile import STACKS
from auditframe.operators.summary import report_order
from auditframe.session import stored

#: Findings of a report, by position, that meet one copy of a rule (as a power of two).
_BLOCK = 16

PRODUCT = "auditframe"
VERSION = "0.1.0"


def _order_struct() -> list[Column]:
    return [
        (-S.severity_ord("severity")).alias("o1"),
        (-S.confidence_ord("confidence")).alias("o2"),
        F.col("file").alias("o3"),
        F.coalesce("line", F.lit(0)).alias("o4"),
        F.col("tool").alias("o5"),
        F.col("rule_id").alias("o6"),
        F.col("category").alias("o7"),
        F.col("message").alias("o8"),
    ]


_FIELDS = [
    "rule_id", "tool", "severity", "category", "file", "line", "end_line", "column", "message",
    "confidence", "ai_relevant", "remediation", "references", "tool_version", "agreed_tools",
    "demoted_reason", "raw",
]
_OPTIONAL = {
    "demoted_reason": "string", "raw": "string", "tool_version": "string", "remediation": "string",
    "references": "array<string>", "agreed_tools": "array<string>", "end_line": "int", "column": "int",
}


def _complete(findings: DataFrame) -> DataFrame:
    """With every field that a document may show."""
    absent = {n: F.lit(None).cast(k) for n, k in _OPTIONAL.items() if n not in findings.columns}
    return findings.withColumns(absent) if absent else findings


def with_positions(findings: DataFrame, name: str = "position") -> DataFrame:
    """Add each finding's place in its repository's report, from 0.

    The table is sorted by ranges and stored; a finding's place is its number in its partition plus what earlier
    partitions hold of its repository. So a repository of any size is spread over tasks, and only one row for each
    repository and partition meets in a window.
    """
    placed = stored(findings.orderBy("repo", F.struct(*_order_struct())).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    held = placed.groupBy("repo", part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = W.partitionBy("repo").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("repo", "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__start"))
    numbered = placed.withColumn("__part", part).join(starts, ["repo", "__part"])
    return numbered.withColumn(name, F.col("__at") + F.col("__start")).drop("__at", "__part", "__start")


# --- JSON ------------------------------------------------------------------


def _listed(rows: DataFrame, text: Column, section: int, position: str) -> DataFrame:
    """Entries of a JSON array, one a line: all but the first begin with the comma between them."""
    comma = F.when(F.col(position) > 0, F.lit(",")).otherwise(F.lit(""))
    return _lines(rows, F.array(F.concat(comma, text)), section=F.lit(section), place=position)


def _count_by(findings: DataFrame, column: str, name: str) -> DataFrame:
    """(repo, map of counts): one entry for each value of a small vocabulary."""
    counts = findings.groupBy("repo", column).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(column, "n")))
    return counts.groupBy("repo").agg(F.map_from_entries(entries).alias(name))


def json_lines(
    findings: DataFrame, run_verdicts: DataFrame, profiles: DataFrame | None = None, statuses: DataFrame | None = None,
    constraints: DataFrame | None = None, *, fail_on: str = "critical", min_confidence: str | None = None,
    baseline: bool = False, verbose: bool = False,
) -> DataFrame:
    """One JSON document per repository with a verdict, as ordered lines (repo, sort keys, text).

    ``profiles`` (``repo_profile``), ``constraints`` (``node_constraint``) and ``statuses`` (``analyzer_status``) fill what the
    document says about stacks, the runtime asked for and the analyzers; ``baseline`` says that one was compared.
    """
    kept = [f for f in _FIELDS if verbose or f != "raw"]
    rows = run_verdicts.join(_count_by(findings, "category", "by_category"), "repo", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    rows = rows.withColumn("by_category", F.coalesce("by_category", none))
    detection = []
    if profiles is not None:
        stacks = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in STACKS]))
        known = profiles.select("repo", stacks.alias("stacks"), "languages", F.col("enabled_tools").alias("expected_tools"))
        rows = rows.join(known, "repo", "left")
        detection = ["stacks", "languages", "expected_tools"]
    if constraints is not None:
        rows = rows.join(constraints.select("repo", F.concat("value", F.lit(" ("), "source", F.lit(")")).alias("node_constraint")), "repo", "left")
        detection.append("node_constraint")
    tools = []
    if statuses is not None:
        shown = [c for c in ("tool", "status", "findings", "reason", "version", "duration_ms") if c in statuses.columns]
        ran = statuses.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("analyzers"))
        rows = rows.join(ran, "repo", "left")
        tools = ["analyzers"]
    by_severity = F.struct(*reversed(V.SEVERITIES)).alias("by_severity")
    head = F.struct(
        F.lit(PRODUCT).alias("tool"), F.lit(VERSION).alias("version"), F.lit(1).alias("schema_version"),
        F.col("repo").alias("target"), F.lit(fail_on).alias("fail_on"), F.col("failed"),
        *([F.struct(*detection).alias("detection")] if detection else []),
        F.struct("total", by_severity, "by_category", "ai_relevant").alias("summary"),
        F.struct("vendored", "ignored", "inline_suppressed", "duplicates_removed", "demoted", "test_asserts").alias("dropped"),
        *([F.lit(min_confidence).alias("min_confidence"), F.col("below_confidence").alias("min_confidence_filtered")] if min_confidence else []),
        *([F.struct(F.col("total").alias("new"), "known").alias("baseline")] if baseline else []),
        *tools,
    )
    # The head's closing brace makes room for the list.
    opening = F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"findings":['))
    numbered = with_positions(_complete(findings))
    return (
        _lines(rows, F.array(opening), section=F.lit(0))
        .unionByName(_listed(numbered, F.to_json(F.struct(*kept)), 2, "position"))
        .unionByName(_lines(run_verdicts, F.array(F.lit("]}")), section=F.lit(5)))
    )


# --- SARIF -----------------------------------------------------------------


def rule_first_use(findings: DataFrame, fields: list[str] | None = None, totals: list[Column] | None = None) -> DataFrame:
    """(repo, rule_id, rule_index, fields): rules of a repository numbered by first use in report order.

    Findings are reduced to one row per rule before they are ranked; ``fields`` are those of the first, ``totals``
    further aggregates of a rule's findings.
    """
    fields = fields or []
    totals = totals or []
    first = F.struct(*_order_struct(), *[F.col(f).alias(f"f_{f}") for f in fields])
    firsts = findings.groupBy("repo", "rule_id").agg(F.min(first).alias("first"), *totals)
    order = W.partitionBy("repo").orderBy("first")
    return firsts.select(
        "repo", "rule_id", (F.row_number().over(order) - 1).alias("rule_index"),
        *[F.col(f"first.f_{f}").alias(f) for f in fields], *firsts.columns[3:],
    )


def sarif_lines(findings: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """One SARIF 2.1.0 document per repository, as ordered lines; its rules come in order of first use.

    Repositories of ``everyone`` without a finding get a document with an empty list, which closes alerts.
    """
    numbered = with_positions(_complete(findings)).withColumn("__block", F.shiftright("position", _BLOCK))
    span = [F.min("__block").alias("__from"), F.max("__block").alias("__to")]
    rules = stored(rule_first_use(numbered, ["category", "tool", "severity", "ai_relevant", "references"], span))
    level = S.lookup(F.col("severity"), V.SARIF_LEVEL, "warning")
    score = S.lookup(F.col("severity"), V.SARIF_SCORE, "5.0")
    tags = F.concat(
        F.array(F.lit("security"), F.col("category")),
        F.when(F.col("ai_relevant"), F.array(F.lit("ai-codegen"))).otherwise(F.array().cast("array<string>")),
    )
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"),
        F.struct(F.concat("category", F.lit(" ("), "tool", F.lit(")")).alias("text")).alias("shortDescription"),
        F.get("references", F.lit(0)).alias("helpUri"),
        F.struct(tags.alias("tags"), score.alias("security-severity"), "category", F.col("tool").alias("producer")).alias("properties"),
    )
    region = F.when(
        F.col("line").isNotNull(),
        F.struct(F.col("line").alias("startLine"), F.col("end_line").alias("endLine"), F.when(F.col("column") > 0, F.col("column")).alias("startColumn")),
    )
    uri = F.struct(F.coalesce(S.nonempty("file"), F.lit(".")).alias("uri"))
    place = F.struct(F.struct(uri.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    fix = F.coalesce(F.concat(F.lit("\n\nRemediation: "), S.nonempty("remediation")), F.lit(""))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"),
        F.struct(F.concat("message", fix).alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.struct(S.fingerprint().alias(PRODUCT + "/v1")).alias("partialFingerprints"),
        F.struct(
            "severity", "confidence", "category", "tool",
            F.col("ai_relevant").alias("aiRelevant"), F.col("agreed_tools").alias("agreedTools"),
        ).alias("properties"),
    )
    # A long report is many blocks, each of which meets its own copy of a rule; most reports are one.
    dealt = rules.select("repo", "rule_id", "rule_index", F.explode(F.sequence("__from", "__to")).alias("__block"))
    indexed = numbered.join(dealt, ["repo", "rule_id", "__block"])
    repos = (rules if everyone is None else everyone).select("repo").distinct()
    driver = F.to_json(F.struct(F.lit(PRODUCT).alias("name"), F.lit(VERSION).alias("version")))
    head = F.concat(
        F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'),
        F.regexp_replace(driver, r"\}$", ""), F.lit(',"rules":['),
    )
    return (
        _lines(repos, F.array(head), section=F.lit(0))
        .unionByName(_listed(rules, F.to_json(rule), 1, "rule_index"))
        .unionByName(_lines(repos, F.array(F.lit(']}},"results":[')), section=F.lit(2)))
        .unionByName(_listed(indexed, F.to_json(result), 3, "position"))
        .unionByName(_lines(repos, F.array(F.lit("]}]}")), section=F.lit(5)))
    )


# --- lines -----------------------------------------------------------------

# Sort columns of a line table; nulls of unused ones keep their place.
LINE_ORDER = ["repo", "section", "place", "group", "step", "conf", "file", "line", "tool", "rule_id", "message", "seq"]
_TYPES = {
    "section": "int", "place": "bigint", "group": "int", "step": "int", "conf": "int", "file": "string", "line": "int",
    "tool": "string", "rule_id": "string", "message": "string", "seq": "int",
}


def _lines(df: DataFrame, texts: Column, **keys) -> DataFrame:
    """Explode an array of texts to line rows with the given sort keys."""
    columns = [
        (S.col_of(keys[k]) if isinstance(keys.get(k), str) else keys[k] if k in keys else F.lit(None)).cast(kind).alias(k)
        for k, kind in _TYPES.items()
        if k != "seq"
    ]
    return df.select("repo", *columns, F.posexplode(texts).alias("seq", "text"))


def _title(severity: str) -> str:
    return severity.capitalize()


def _place() -> Column:
    return F.concat(F.col("file"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))


def markdown_finding() -> Column:
    """One bullet per finding."""
    place = F.when(F.col("file") != "", S.markdown_code(_place())).otherwise(F.lit("_(whole project)_"))
    agreed = F.when(
        F.size("agreed_tools") > 1, F.concat(F.lit(", agreed: "), F.array_join("agreed_tools", "/"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("- **["), S.markdown_escape("category"), F.lit("]** "), place, F.lit(": "),
        S.markdown_escape("message"), F.lit(" _("), S.markdown_escape("tool"), F.lit(", "), F.col("confidence"),
        F.lit(" confidence"), agreed, F.lit(")_"),
        F.when(F.col("ai_relevant"), F.lit(" `ai-codegen`")).otherwise(F.lit("")),
    )


def _finding_lines(findings: DataFrame, texts: Column) -> DataFrame:
    return _lines(
        findings, texts, section=F.lit(2), group=-S.severity_ord("severity"), step=F.lit(1),
        conf=-S.confidence_ord("confidence"), file="file", line=F.coalesce("line", F.lit(0)), tool="tool",
        rule_id="rule_id", message="message",
    )


def markdown_lines(findings: DataFrame, run_verdicts: DataFrame, statuses: DataFrame | None = None,
                   fail_on: str = "critical") -> DataFrame:
    """Summary for a pull request as ordered lines (repo, sort keys, text)."""
    verdict = F.when(
        F.col("failed"), F.lit(f"**Failed**: there are findings of severity `{fail_on}` or above")
    ).otherwise(F.lit(f"**Passed**: no finding of severity `{fail_on}` or above"))
    notes = F.array_join(
        F.array_compact(
            F.array(
                *[
                    F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
                    for c, text in [
                        ("ai_relevant", " typical of generated code"),
                        ("ignored", " suppressed by ignore lists"),
                        ("inline_suppressed", " suppressed in the source"),
                        ("duplicates_removed", " duplicates merged"),
                    ]
                ]
            )
        ),
        " · ",
    )
    head = F.array_compact(
        F.array(
            F.lit("## Security scan"), verdict, F.concat(F.lit("**Target:** "), S.markdown_code("repo")),
            F.lit("### Summary"), F.lit("| Severity | Count |"), F.lit("| --- | --- |"),
            *[F.concat(F.lit(f"| {_title(s)} | "), F.col(s).cast("string"), F.lit(" |")) for s in reversed(V.SEVERITIES)],
            F.concat(F.lit("| **Total** | **"), F.col("total").cast("string"), F.lit("** |")),
            F.when(notes != "", F.concat(F.lit("_"), notes, F.lit("_"))),
            F.lit("### Findings"), F.when(F.col("total") == 0, F.lit("No findings.")),
        )
    )
    parts = [_lines(run_verdicts, head, section=F.lit(0))]
    levels = F.inline(
        F.array(*[F.struct(F.lit(-V.SEVERITY_ORD[s]).alias("g"), F.lit(_title(s)).alias("title"), F.col(s).alias("n"))
                  for s in reversed(V.SEVERITIES)])
    )
    groups = run_verdicts.select("repo", levels).filter(F.col("n") > 0)
    opened = F.when(F.col("g") <= -V.SEVERITY_ORD["high"], F.lit("<details open>")).otherwise(F.lit("<details>"))
    opening = F.array(
        opened,
        F.concat(F.lit("<summary><strong>"), F.col("title"), F.lit("</strong> ("), F.col("n").cast("string"), F.lit(")</summary>")),
        F.lit(""),
    )
    parts.append(_lines(groups, opening, section=F.lit(2), group="g", step=F.lit(0)))
    bullets = [markdown_finding()]
    if "remediation" in findings.columns:
        fix = F.concat(F.lit("  - _fix:_ "), S.markdown_escape("remediation"))
        bullets.append(F.when(S.nonempty("remediation").isNotNull(), fix))
    parts.append(_finding_lines(findings, F.array_compact(F.array(*bullets))))
    parts.append(_lines(groups, F.array(F.lit(""), F.lit("</details>")), section=F.lit(2), group="g", step=F.lit(2)))
    if statuses is not None:
        table = F.array(F.lit("### Analyzers"), F.lit("| Analyzer | Status | Findings | Notes |"), F.lit("| --- | --- | --- | --- |"))
        parts.append(_lines(run_verdicts, table, section=F.lit(3)))
        row = F.concat(
            F.lit("| "), S.markdown_escape("tool"), F.lit(" | "), F.col("status"), F.lit(" | "),
            F.col("findings").cast("string"), F.lit(" | "), S.markdown_escape("reason"), F.lit(" |"),
        )
        parts.append(_lines(statuses, F.array(row), section=F.lit(4), tool="tool"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def text_lines(findings: DataFrame, run_verdicts: DataFrame) -> DataFrame:
    """The grouped console listing as ordered lines (repo, sort keys, text)."""
    place = F.when(F.col("file") != "", _place()).otherwise(F.lit("(project)"))
    agreed = F.when(
        F.size("agreed_tools") > 1, F.concat(F.lit(" (agreed: "), F.array_join("agreed_tools", ", "), F.lit(")"))
    ).otherwise(F.lit(""))
    entry = [
        F.concat(
            F.lit("  "), F.upper("severity"), F.lit(" "), F.col("category"), F.lit("  "), place,
            F.when(F.col("ai_relevant"), F.lit(" [ai-codegen]")).otherwise(F.lit("")),
        ),
        F.concat(F.lit("     "), F.col("message")),
        F.concat(F.lit("     by "), F.col("tool"), F.lit(", confidence: "), F.col("confidence"), agreed),
    ]
    if "remediation" in findings.columns:
        entry.append(F.concat(F.lit("     fix: "), S.nonempty("remediation")))
    if "references" in findings.columns:
        entry.append(
            F.when(F.size("references") > 0, F.concat(F.lit("     see: "), F.array_join(F.slice("references", 1, 3), ", ")))
        )
    levels = F.inline(
        F.array(*[F.struct(F.lit(-V.SEVERITY_ORD[s]).alias("g"), F.lit(s.upper()).alias("title"), F.col(s).alias("n"))
                  for s in reversed(V.SEVERITIES)])
    )
    groups = run_verdicts.select("repo", levels).filter(F.col("n") > 0)
    title = F.concat(F.col("title"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    closing = F.array(
        F.lit("Summary"),
        F.concat_ws(
            ", ", F.concat(F.lit("  "), F.col("total").cast("string"), F.lit(" findings")),
            *[F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s in reversed(V.SEVERITIES)],
        ),
        F.when(F.col("failed"), F.lit("Failed")).otherwise(F.lit("Passed")),
    )
    return (
        _lines(groups, F.array(title), section=F.lit(2), group="g", step=F.lit(0))
        .unionByName(_finding_lines(findings, F.array_compact(F.array(*entry))))
        .unionByName(_lines(run_verdicts, closing, section=F.lit(5)))
    )


def write_lines(line_table: DataFrame, path: str) -> None:
    """One folder per repository; concatenating its files by name gives the report.

    Range partitioning spreads a very long report over several files.
    """
    # Stored first: range partitioning samples its input.
    stored(line_table).repartitionByRange(*LINE_ORDER).sortWithinPartitions(*LINE_ORDER).select("repo", "text").write.mode(
        "overwrite"
    ).partitionBy("repo").text(path)


FORMATS = ["json", "sarif", "markdown", "text"]


def render_report(findings: DataFrame, run_verdicts: DataFrame, format: str = "text", **options) -> DataFrame:
    """Report rows in one of ``FORMATS``; an unknown format means ``text``."""
    if format == "json":
        return json_lines(findings, run_verdicts, **options)
    if format == "sarif":
        return sarif_lines(findings, everyone=run_verdicts, **options)
    if format == "markdown":
        return markdown_lines(findings, run_verdicts, **options)
    return text_lines(findings, run_verdicts)
