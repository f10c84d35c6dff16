"""Scanner reports as findings. ``reports(repo, tool, payload, ...)``, one row per report.

Each reader parses the payload once with an explicit schema (so only the fields
in use are materialised), explodes its arrays and projects the findings schema.
Nothing is grouped or shuffled. Numbers are declared as text because scanners
write them either way; coercion happens in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import scalars as S
from auditframe.operators.findings import concat_findings, make_findings
from auditframe.operators.joins import salted_join
from auditframe.sources.files import lines, listed

ROTATE = "Revoke and replace this credential, then delete it from the files and the history; load it from a secret store."


def _parsed(reports: DataFrame, tool: str, schema: str) -> DataFrame:
    return (
        reports.filter(F.col("tool") == tool)
        .withColumn("doc", F.from_json("payload", schema))
        .drop("payload", "tool")
    )


def _list_or_field(reports: DataFrame, tool: str, item: str, field: str) -> DataFrame:
    """Parse payloads whose list is either the root or a field of the root object."""
    listing = F.from_json("payload", f"array<{item}>")
    inside = F.from_json("payload", f"struct<`{field}`:array<{item}>>")[field]
    is_list = F.ltrim("payload").startswith("[")
    return (
        reports.filter(F.col("tool") == tool)
        .withColumn("items", F.when(is_list, listing).otherwise(inside))
        .drop("payload", "tool")
    )


def _items(df: DataFrame, array: str | Column, name: str = "item") -> DataFrame:
    """One row per entry.

    The outer form matters: from the inner one the optimiser derives a filter
    on the array, which would parse every payload again below the projection.
    """
    return df.withColumn(name, F.explode_outer(array)).filter(F.col(name).isNotNull())


# --- code scanners ---------------------------------------------------------


def read_semgrep(reports: DataFrame, tag: str = "af") -> DataFrame:
    """``results[]``; rules may carry ``<tag>-category/-severity/-ai-codegen/-remediation`` metadata."""
    meta_fields = ", ".join(
        f"`{tag}{name}`: string"
        for name in ["-category", "_category", "-severity", "-ai-codegen", "_ai_codegen", "-remediation"]
    )
    meta = (
        f"struct<{meta_fields}, category: string, confidence: string, tags: array<string>,"
        " references: array<string>, owasp: array<string>, cwe: array<string>>"
    )
    schema = (
        "version string, results array<struct<check_id: string, path: string,"
        " start: struct<line: string, col: string>, end: struct<line: string>,"
        f" extra: struct<message: string, severity: string, fix: string, metadata: {meta}>>>"
    )
    rows = _items(_parsed(reports, "semgrep", schema), "doc.results").withColumns(
        {
            "extra": F.col("item.extra"),
            "meta": F.col("item.extra.metadata"),
            "rule": F.col("item.check_id"),
            "hint": F.lower(F.concat_ws(" ", "item.check_id", "item.extra.message")),
        }
    )

    def m(name: str) -> Column:
        return F.col("meta")[name]

    def valid(c: Column) -> Column:
        return F.when(c.isin(S.V.CATEGORIES), c)

    no_list = F.array().cast("array<string>")
    links = F.concat(*[F.coalesce(m(n), no_list) for n in ("references", "owasp", "cwe")])
    message = S.nonempty("extra.message")
    ai = F.coalesce(m(f"{tag}-ai-codegen"), m(f"{tag}_ai_codegen")) == "true"
    return make_findings(
        rows,
        repo="repo",
        tool=F.lit("semgrep"),
        rule_id=F.coalesce(S.nonempty("rule"), F.lit("semgrep")),
        severity=F.when(
            S.nonempty(m(f"{tag}-severity")).isNotNull(), S.normalize_severity(m(f"{tag}-severity"))
        ).otherwise(S.normalize_severity("extra.severity")),
        category=F.coalesce(
            valid(S.first_nonempty(m(f"{tag}-category"), m(f"{tag}_category"))),
            valid(m("category")),
            S.infer_category("hint"),
        ),
        file="item.path",
        line="item.start.line",
        end_line="item.end.line",
        column="item.start.col",
        message=F.coalesce(message, S.nonempty("rule"), F.lit("Semgrep match")),
        confidence=S.map_confidence(m("confidence"), "high"),
        ai_relevant=F.coalesce(ai, F.lit(False))
        | F.coalesce(F.array_contains(m("tags"), "ai-codegen"), F.lit(False)),
        references=links,
        remediation=F.coalesce(
            S.nonempty(m(f"{tag}-remediation")), F.concat(F.lit("Proposed fix: "), S.nonempty("extra.fix"))
        ),
        tool_version="doc.version",
    )


def read_eslint(reports: DataFrame) -> DataFrame:
    """File x message; only security rules. A ``root`` column makes absolute paths relative."""
    schema = (
        "array<struct<filePath: string, messages: array<struct<ruleId: string, fatal: boolean,"
        " message: string, line: string, column: string, endLine: string>>>>"
    )
    parsed = _parsed(reports, "eslint", schema)
    path = F.col("file.filePath")
    if "root" in reports.columns:
        root = F.concat(F.col("root"), F.lit("/"))
        path = F.when(F.startswith(path, root), F.substr(path, F.length(root) + 1)).otherwise(path)
    rows = _items(_items(parsed, "doc", "file"), "file.messages", "msg").filter(
        F.coalesce(~F.col("msg.fatal"), F.lit(True))
        & S.starts_with_any(F.col("msg.ruleId"), ["security/", "no-unsanitized/"])
    )
    rows = rows.withColumn("meta", S.eslint_meta("msg.ruleId"))
    return make_findings(
        rows,
        repo="repo",
        tool=F.lit("eslint"),
        rule_id="msg.ruleId",
        severity="meta.severity",
        category="meta.category",
        confidence="meta.confidence",
        file=path,
        line="msg.line",
        end_line="msg.endLine",
        column="msg.column",
        message="msg.message",
        tool_version="version" if "version" in reports.columns else None,
    )


def read_bandit(reports: DataFrame) -> DataFrame:
    schema = (
        "results array<struct<test_id: string, test_name: string, filename: string, issue_severity: string,"
        " issue_confidence: string, issue_text: string, line_number: string, more_info: string,"
        " issue_cwe: struct<link: string>>>"
    )
    rows = _items(_parsed(reports, "bandit", schema), "doc.results")
    rows = rows.withColumn("hint", F.lower(F.concat_ws(" ", "item.test_name", "item.issue_text")))
    test_id, name = S.nonempty("item.test_id"), S.nonempty("item.test_name")
    return make_findings(
        rows,
        repo="repo",
        tool=F.lit("bandit"),
        rule_id=F.coalesce(
            F.concat(test_id, F.lit(" ("), F.coalesce(name, F.lit("")), F.lit(")")), name, F.lit("bandit")
        ),
        severity=S.normalize_severity("item.issue_severity"),
        category=F.coalesce(
            S.bandit_category("item.test_id"),
            S.infer_category("hint"),
        ),
        file="item.filename",
        line="item.line_number",
        message=F.coalesce(S.nonempty("item.issue_text"), name, F.lit("Bandit match")),
        confidence=S.map_confidence("item.issue_confidence", "medium"),
        references=F.array_compact(F.array(S.nonempty("item.more_info"), S.nonempty("item.issue_cwe.link"))),
    )


# --- secret scanners -------------------------------------------------------


def read_gitleaks(reports: DataFrame) -> DataFrame:
    """Root array; field names in either case. A match in history names its commit."""
    # JSON field names differ in case only, so they are looked up in a map.
    rows = _items(_parsed(reports, "gitleaks", "array<map<string,string>>"), "doc", "leak")

    def f(*names: str) -> Column:
        return F.coalesce(*[F.col("leak")[n] for n in names])

    commit, match = S.nonempty(f("Commit")), S.nonempty(f("Match"))
    return make_findings(
        rows,
        repo="repo",
        tool=F.lit("gitleaks"),
        rule_id=F.coalesce(S.nonempty(f("RuleID")), F.lit("gitleaks.secret")),
        severity=S.secret_severity(f("RuleID")),
        category=F.lit("secrets"),
        file=S.first_nonempty(f("File"), f("file")),
        line=f("StartLine", "startLine"),
        end_line=f("EndLine", "endLine"),
        column=f("StartColumn", "startColumn"),
        message=F.concat(
            F.coalesce(S.first_nonempty(f("Description"), f("RuleID")), F.lit("Secret in the code")),
            F.coalesce(F.concat(F.lit(" (commit "), F.left(commit, F.lit(8)), F.lit(")")), F.lit("")),
            F.lit("."),
            F.when(match.isNotNull(), F.concat(F.lit(" Found: "), S.redact(match))).otherwise(F.lit("")),
        ),
        confidence=F.lit("high"),
        remediation=F.lit(ROTATE),
    )


def read_trufflehog(reports: DataFrame) -> DataFrame:
    """JSON lines; progress lines without a detector or source are skipped."""
    source = "map<string,string>"
    schema = (
        "DetectorName string, DetectorType string, Verified string, Raw string, RawV2 string, Redacted string,"
        f" SourceMetadata struct<Data: struct<Filesystem: {source}, Git: {source}, Directory: {source}>>"
    )
    # Broken lines parse to nothing but nulls and leave with the other lines
    # that name neither detector nor source. Exploding keeps the parse in one place. Empty payloads leave as lines, since
    # a filter on payloads would make each of them a second time where they are derived.
    texts = lines(reports.filter(F.col("tool") == "trufflehog"), ["repo"], "payload")
    texts = texts.filter(F.col("text").contains("{"))
    recs = texts.select("repo", F.explode(F.array(F.from_json(S.strip("text"), schema))).alias("rec"))
    recs = recs.filter(S.nonempty("rec.DetectorName").isNotNull() | F.col("rec.SourceMetadata").isNotNull())
    data = F.col("rec.SourceMetadata.Data")
    recs = recs.withColumn("src", F.coalesce(data["Filesystem"], data["Git"], data["Directory"]))
    verified = F.coalesce(F.col("rec.Verified") == "true", F.lit(False))
    detector = F.coalesce(S.first_nonempty("rec.DetectorName", "rec.DetectorType"), F.lit("secret"))
    shown = F.coalesce(S.nonempty("rec.Redacted"), S.redact(S.first_nonempty("rec.Raw", "rec.RawV2")))
    return make_findings(
        recs,
        repo="repo",
        tool=F.lit("trufflehog"),
        rule_id=F.concat(F.lit("trufflehog."), detector),
        severity=F.when(verified, F.lit("critical")).otherwise(F.lit("high")),
        category=F.lit("secrets"),
        file=S.first_nonempty(F.col("src")["file"], F.col("src")["File"]),
        line=F.coalesce(F.col("src")["line"], F.col("src")["Line"]),
        message=F.concat(
            F.when(verified, F.lit("Confirmed ")).otherwise(F.lit("Possible ")),
            detector, F.lit(" secret ("), shown, F.lit(")."),
        ),
        confidence=F.when(verified, F.lit("high")).otherwise(F.lit("medium")),
        remediation=F.lit(ROTATE),
    )


# --- dependency scanners ---------------------------------------------------


def manifest_paths(listing: DataFrame) -> DataFrame:
    """Per repository the manifest an npm report is about: next to its first npm lockfile."""
    locks = listing.filter(
        listed() & S.basename("path").isin("package-lock.json", "npm-shrinkwrap.json")
    )
    first = locks.groupBy("repo").agg(F.min("path").alias("lock"))
    folder = S.dirname("lock")
    return first.select(
        "repo",
        F.when(folder == ".", F.lit("package.json")).otherwise(F.concat(folder, F.lit("/package.json"))).alias("manifest"),
    )


def requirement_paths(listing: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Per repository the requirements file a pip-audit report is about."""
    found = listing.filter(listed(max_depth=max_depth, name_pattern=r"(?i)^requirements.*\.txt$"))
    return found.groupBy("repo").agg(F.min("path").alias("manifest"))


def _with_manifest(rows: DataFrame, manifests: DataFrame | None, default: str, spread: str) -> DataFrame:
    """With the manifest that a repository's rows are about; a repository with very many rows is spread by ``spread``."""
    if manifests is None:
        return rows.withColumn("manifest", F.lit(default))
    return salted_join(rows, manifests, ["repo"], [spread]).withColumn("manifest", F.coalesce("manifest", F.lit(default)))


def _affected(versions: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" (versions "), S.nonempty(versions), F.lit(")")), F.lit(""))


def read_npm_v7(reports: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Map ``vulnerabilities``. ``via`` mixes names and advisory objects; objects stay JSON text.

    An advisory listed twice under one package counts once; packages are map
    keys, so that check needs only the package's own ``via`` list.
    """
    schema = (
        "vulnerabilities map<string, struct<severity: string, range: string, via: array<string>,"
        " fixAvailable: string>>"
    )
    advisory = "source string, title string, url string, severity string, range string"
    rows = (
        _parsed(reports, "npm-audit", schema)
        .select("repo", F.explode_outer("doc.vulnerabilities").alias("package", "vuln"))
        .filter(F.col("package").isNotNull())
        .withColumn("objects", F.filter("vuln.via", lambda v: v.startswith("{")))
        .withColumn("advisories", F.transform("objects", lambda v: F.from_json(v, advisory)))
        .withColumn(
            "ids",
            F.transform(
                "advisories",
                lambda a: F.coalesce(S.ghsa_id(a["url"]), S.first_nonempty(a["source"], a["title"]), F.lit("")),
            ),
        )
        .withColumn(
            "firsts",
            F.filter("advisories", lambda a, i: F.array_position("ids", F.get("ids", i)) == i + 1),
        )
        .withColumn("adv", F.explode_outer("firsts"))
    )
    rows = _with_manifest(rows, manifests, "package.json", "package")
    ghsa, listed_adv = S.ghsa_id("adv.url"), F.col("adv").isNotNull()
    by_package = F.concat(F.lit("npm-audit."), F.col("package"))
    return make_findings(
        rows,
        repo="repo",
        tool=F.lit("npm-audit"),
        rule_id=F.when(
            listed_adv, F.coalesce(ghsa, F.concat(F.lit("npm-audit."), S.nonempty("adv.source")), by_package)
        ).otherwise(by_package),
        severity=S.normalize_severity(S.first_nonempty("adv.severity", "vuln.severity")),
        category=F.lit("dependency-cve"),
        file="manifest",
        message=F.when(
            listed_adv,
            F.concat(
                F.coalesce(S.nonempty("adv.title"), F.lit("Published vulnerability")),
                F.lit(': package "'), F.col("package"), F.lit('"'), _affected(F.col("adv.range")), F.lit("."),
            ),
        ).otherwise(
            F.concat(F.lit('Package "'), F.col("package"), F.lit('" is vulnerable'), _affected(F.col("vuln.range")), F.lit("."))
        ),
        confidence=F.lit("high"),
        references=F.array_compact(F.array(S.nonempty("adv.url"))),
        remediation=S.npm_fix_text("vuln.fixAvailable", "package"),
    )


def read_npm_v6(reports: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Map ``advisories``; only for payloads without ``vulnerabilities``."""
    schema = (
        "vulnerabilities string, advisories map<string, struct<id: string, github_advisory_id: string,"
        " severity: string, title: string, module_name: string, vulnerable_versions: string, url: string,"
        " recommendation: string>>"
    )
    advisories = F.when(F.col("doc.vulnerabilities").isNull(), F.map_values("doc.advisories"))
    rows = _items(_parsed(reports, "npm-audit", schema), advisories, "adv")
    rows = _with_manifest(rows, manifests, "package.json", "adv")
    return make_findings(
        rows,
        repo="repo",
        tool=F.lit("npm-audit"),
        rule_id=F.coalesce(
            S.nonempty("adv.github_advisory_id"), F.concat(F.lit("npm-audit."), F.col("adv.id"))
        ),
        severity=S.normalize_severity("adv.severity"),
        category=F.lit("dependency-cve"),
        file="manifest",
        message=F.concat(
            F.coalesce(S.nonempty("adv.title"), F.lit("Published vulnerability")),
            F.lit(': package "'), F.coalesce("adv.module_name", F.lit("")), F.lit('"'),
            _affected(F.col("adv.vulnerable_versions")), F.lit("."),
        ),
        confidence=F.lit("high"),
        references=F.array_compact(F.array(S.nonempty("adv.url"))),
        remediation="adv.recommendation",
    )


def read_pip_audit(reports: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Dependencies x ``vulns[]``, from a root array or ``dependencies``."""
    item = (
        "struct<name: string, version: string, vulns: array<struct<id: string, severity: string,"
        " fix_versions: array<string>, aliases: array<string>>>>"
    )
    rows = _items(_items(_list_or_field(reports, "pip-audit", item, "dependencies"), "items", "dep"), "dep.vulns", "vuln")
    rows = _with_manifest(rows, manifests, "requirements.txt", "vuln")
    name = F.coalesce("dep.name", F.lit(""))
    aliases = F.when(
        F.size("vuln.aliases") > 0, F.concat(F.lit(" ("), F.array_join("vuln.aliases", ", "), F.lit(")"))
    ).otherwise(F.lit(""))
    fixes = F.when(
        F.size("vuln.fix_versions") > 0,
        F.concat(F.lit('Raise "'), name, F.lit('" to '), F.array_join("vuln.fix_versions", " or "), F.lit(".")),
    )
    return make_findings(
        rows,
        repo="repo",
        tool=F.lit("pip-audit"),
        rule_id=F.coalesce(S.nonempty("vuln.id"), F.concat(F.lit("pip-audit."), name)),
        severity=S.normalize_severity("vuln.severity", "high"),
        category=F.lit("dependency-cve"),
        file="manifest",
        message=F.concat(
            F.coalesce(S.nonempty("vuln.id"), F.lit("Published vulnerability")), aliases,
            F.lit(' affects "'), name, F.lit('" '), F.coalesce("dep.version", F.lit("")), F.lit("."),
        ),
        confidence=F.lit("high"),
        references=S.advisory_links("vuln.id", "vuln.aliases"),
        remediation=F.coalesce(fixes, F.lit("No fixed version is listed; the advisory may name a workaround.")),
    )


# --- trivy -----------------------------------------------------------------

_TRIVY = {
    "Vulnerabilities": (
        "VulnerabilityID: string, Severity: string, Title: string, PkgName: string,"
        " InstalledVersion: string, FixedVersion: string, PrimaryURL: string"
    ),
    "Misconfigurations": (
        "AVDID: string, ID: string, Severity: string, Title: string, Message: string, Description: string,"
        " Resolution: string, PrimaryURL: string, CauseMetadata: struct<StartLine: string, EndLine: string>"
    ),
    "Secrets": (
        "RuleID: string, Severity: string, Title: string, Category: string, Match: string,"
        " StartLine: string, EndLine: string"
    ),
}


def _trivy_items(reports: DataFrame, part: str) -> DataFrame:
    schema = f"Results array<struct<Target: string, Class: string, {part}: array<struct<{_TRIVY[part]}>>>>"
    results = _items(_parsed(reports, "trivy", schema), "doc.Results", "res")
    return _items(results, F.col("res")[part]).withColumn("target", S.first_nonempty("res.Target", "res.Class"))


def read_trivy_vulnerabilities(reports: DataFrame) -> DataFrame:
    package = F.coalesce(S.nonempty("item.PkgName"), F.lit("package"))
    return make_findings(
        _trivy_items(reports, "Vulnerabilities"),
        repo="repo",
        tool=F.lit("trivy"),
        rule_id=F.coalesce(S.nonempty("item.VulnerabilityID"), F.lit("trivy.vuln")),
        severity=S.normalize_severity("item.Severity"),
        category=F.lit("dependency-cve"),
        file="target",
        message=F.concat(
            F.coalesce(S.first_nonempty("item.Title", "item.VulnerabilityID"), F.lit("Vulnerability")),
            F.lit(": "), package, F.lit(" "), F.coalesce("item.InstalledVersion", F.lit("")), F.lit("."),
        ),
        confidence=F.lit("high"),
        references=F.array_compact(F.array(S.nonempty("item.PrimaryURL"))),
        remediation=F.concat(F.lit("Raise "), package, F.lit(" to "), S.nonempty("item.FixedVersion"), F.lit(".")),
    )


def read_trivy_misconfigurations(reports: DataFrame) -> DataFrame:
    return make_findings(
        _trivy_items(reports, "Misconfigurations"),
        repo="repo",
        tool=F.lit("trivy"),
        rule_id=F.coalesce(S.first_nonempty("item.AVDID", "item.ID"), F.lit("trivy.misconfig")),
        severity=S.normalize_severity("item.Severity"),
        category=F.lit("iac-misconfig"),
        file="target",
        line="item.CauseMetadata.StartLine",
        end_line="item.CauseMetadata.EndLine",
        message=F.concat(
            F.coalesce(S.first_nonempty("item.Title", "item.ID"), F.lit("Misconfiguration")),
            F.lit(": "), F.coalesce(S.first_nonempty("item.Message", "item.Description"), F.lit("")),
        ),
        confidence=F.lit("high"),
        references=F.array_compact(F.array(S.nonempty("item.PrimaryURL"))),
        remediation="item.Resolution",
    )


def read_trivy_secrets(reports: DataFrame) -> DataFrame:
    return make_findings(
        _trivy_items(reports, "Secrets"),
        repo="repo",
        tool=F.lit("trivy"),
        rule_id=F.coalesce(S.nonempty("item.RuleID"), F.lit("trivy.secret")),
        severity=S.normalize_severity("item.Severity", "high"),
        category=F.lit("secrets"),
        file="target",
        line="item.StartLine",
        end_line="item.EndLine",
        message=F.concat(
            F.coalesce(S.first_nonempty("item.Title", "item.Category"), F.lit("Secret")),
            F.lit(" found ("), S.redact("item.Match"), F.lit(")."),
        ),
        confidence=F.lit("high"),
        remediation=F.lit(ROTATE),
    )


def read_trivy(reports: DataFrame) -> DataFrame:
    return concat_findings(
        read_trivy_vulnerabilities(reports), read_trivy_misconfigurations(reports), read_trivy_secrets(reports)
    )


# --- all scanners ----------------------------------------------------------

READERS: dict[str, list[Callable[[DataFrame], DataFrame]]] = {
    "semgrep": [read_semgrep],
    "gitleaks": [read_gitleaks],
    "trufflehog": [read_trufflehog],
    "npm-audit": [read_npm_v7, read_npm_v6],
    "pip-audit": [read_pip_audit],
    "eslint": [read_eslint],
    "bandit": [read_bandit],
    "trivy": [read_trivy],
}


def read_reports(reports: DataFrame, tools: list[str] | None = None) -> DataFrame:
    """Findings of every report; each reader scans only its own tool's rows."""
    chosen = tools or list(READERS)
    return concat_findings(*[read(reports) for tool in chosen for read in READERS[tool]])


def report_status(reports: DataFrame) -> DataFrame:
    """ok, error, timeout or skipped per report.

    Optional columns: ``exit_code``, ``timed_out``, ``not_found``, ``reason``.
    A report nobody can parse is an error only if its tool failed as well.
    """
    have = set(reports.columns)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in have else F.lit(False)

    failed = F.coalesce(F.col("exit_code") != 0, F.lit(False)) if "exit_code" in have else F.lit(False)
    lined = F.col("tool") == "trufflehog"
    unparsed = ~lined & F.try_parse_json("payload").isNull()
    status = (
        F.when(flag("timed_out"), F.lit("timeout"))
        .when(flag("not_found"), F.lit("skipped"))
        .when(failed & unparsed, F.lit("error"))
        .otherwise(F.lit("ok"))
    )
    given = F.col("reason") if "reason" in have else F.lit(None).cast("string")
    return reports.withColumn("status", status).withColumn(
        "reason",
        F.when(F.col("status") == "ok", F.lit(None).cast("string"))
        .when(F.col("status") == "timeout", F.coalesce(given, F.lit("timed out")))
        .when(F.col("status") == "skipped", F.coalesce(given, F.lit("not installed")))
        .otherwise(F.coalesce(given, F.concat(F.lit("exit code "), F.col("exit_code").cast("string"), F.lit(", unreadable output"))))
        if "exit_code" in have
        else given,
    )


def analyzer_status(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository and tool: worst status, reports and raw findings, version and milliseconds taken.

    ``reports`` may have the columns ``version`` and ``duration_ms``; without the first, the version is what a payload says of
    itself. Both sides are counted before they meet, so the join sees one row per key.
    """
    have = reports.columns
    said = F.when(F.col("tool") == "semgrep", S.nonempty(F.get_json_object("payload", "$.version")))
    version = F.coalesce(F.col("version"), said) if "version" in have else said
    duration = F.col("duration_ms").cast("long") if "duration_ms" in have else F.lit(None).cast("long")
    worst = {"ok": 0, "skipped": 1, "timeout": 2, "error": 3}
    runs = (
        report_status(reports)
        .withColumns({"__version": version, "__took": duration})
        .groupBy("repo", "tool")
        .agg(F.max(F.struct(S.lookup(F.col("status"), worst).alias("o"), F.col("status"), F.col("reason"))).alias("w"),
             F.count("*").alias("reports"), F.max("__version").alias("version"), F.sum("__took").alias("duration_ms"))
        .select("repo", "tool", F.col("w.status").alias("status"), F.col("w.reason").alias("reason"), "reports", "version", "duration_ms")
    )
    found = findings.groupBy("repo", "tool").agg(F.count("*").alias("findings"))
    return runs.join(found, ["repo", "tool"], "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
