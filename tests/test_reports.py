"""Scanner payloads in, report documents out."""

import glob
import json

from pyspark.sql import functions as F

from auditframe.operators import dedup as D
from auditframe.operators import profile as P
from auditframe.plans import reports as R
from auditframe.plans import scan as C
from auditframe.sources import reports as X
from auditframe.sources.config import read_baseline
from tests.test_findings import make

REPORTS = "repo string, tool string, payload string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_malformed_payloads_give_no_findings(spark):
    bad = ["", "not json", "[]", "{}", "null", '{"results": 3}', '{"vulnerabilities": [1]}', '[{"messages": null}]']
    reports = spark.createDataFrame([("r", t, p) for t in X.READERS for p in bad], REPORTS)
    found = X.read_reports(reports)
    # only an array entry that says nothing becomes a gitleaks row
    assert rows(found, "tool", "rule_id") == [("gitleaks", "gitleaks.secret")]


def test_semgrep_numbers_as_text(spark):
    payload = json.dumps({"version": 1.5, "results": [
        {"check_id": "a.sqli", "path": "./x.py", "start": {"line": "7", "col": 0}, "extra": {"message": " m ", "severity": "ERROR",
         "metadata": {"tags": ["ai-codegen"], "owasp": ["A1"], "references": "no list", "confidence": "LOW"}}},
        {"check_id": "b", "path": "y.py", "extra": {"severity": "weird", "metadata": {"af-category": "ssrf", "af-severity": "crit", "af-ai-codegen": True}}},
    ]})
    found = X.read_semgrep(spark.createDataFrame([("r", "semgrep", payload)], REPORTS))
    got = found.orderBy("file").collect()
    assert (got[0].file, got[0].line, got[0].column, got[0].severity, got[0].category, got[0].confidence) == ("x.py", 7, 0, "high", "injection", "low")
    assert got[0].ai_relevant and got[0].references == ["A1"] and got[0].message == "m" and got[0].tool_version == "1.5"
    assert (got[1].severity, got[1].category, got[1].ai_relevant, got[1].message) == ("critical", "ssrf", True, "b")


def test_npm_counts_an_advisory_once_per_package(spark):
    adv = {"title": "T", "url": "https://x/GHSA-1-2", "severity": "high"}
    payload = json.dumps({"vulnerabilities": {
        "a": {"severity": "low", "via": ["b", adv, adv, {"title": "U"}], "fixAvailable": True},
        "b": {"severity": "moderate", "range": "<2", "via": ["a"], "fixAvailable": {"name": "b", "version": "2", "isSemVerMajor": True}},
    }})
    manifests = spark.createDataFrame([("r", "web/package.json")], "repo string, manifest string")
    found = X.read_npm_v7(spark.createDataFrame([("r", "npm-audit", payload)], REPORTS), manifests)
    assert rows(found, "rule_id", "severity", "file") == [
        ("GHSA-1-2", "high", "web/package.json"), ("npm-audit.a", "low", "web/package.json"), ("npm-audit.b", "medium", "web/package.json"),
    ]


def _issues(spark):
    findings = [("r", "semgrep", f"R{i % 3}", "high" if i % 2 else "low", "injection", f"f{i}.py", str(i + 1), f"m|{i}", "high") for i in range(20)]
    findings.append(("r", "trivy", "CVE", "critical", "dependency-cve", "", None, "m", "high"))
    return C.issues(make(spark, findings))


def whole(lines):
    """Lines of a report put together, one document per repository."""
    texts = {}
    for r in lines.orderBy(*R.LINE_ORDER).collect():
        texts.setdefault(r.repo, []).append(r.text)
    return {repo: json.loads("\n".join(t)) for repo, t in texts.items()}


def _many_issues(spark):
    """A third of all findings in one repository, in more partitions than one, and a repository without any."""
    rows = [(f"r{i % 40 if i % 3 else 'hot'}", "semgrep", f"R{i % 7}", ("high", "low", "critical")[i % 5 % 3], "injection", f"f{i % 11}.py", str(i), f"m{i}", "high") for i in range(900)]
    return make(spark, rows).repartition(5)


def test_positions_over_partitions(spark):
    shown = C.reported(C.issues(_many_issues(spark)))
    rows = R.with_positions(shown).collect()
    by = {}
    for r in rows:
        by.setdefault(r.repo, []).append(r)
    assert len(rows) == 900 and max(len(x) for x in by.values()) == 300
    for mine in by.values():
        mine.sort(key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine)))
        keys = [(-S_ORD[r.severity], r.file, r.line or 0) for r in mine]
        assert keys == sorted(keys)


S_ORD = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def test_sarif_is_one_document_per_repository(spark):
    shown = C.reported(C.issues(_many_issues(spark)))
    everyone = shown.select("repo").union(spark.createDataFrame([("quiet",)], "repo string"))
    documents = whole(R.sarif_lines(shown, everyone))
    assert documents["quiet"]["runs"][0]["results"] == [] and sum(len(d["runs"][0]["results"]) for d in documents.values()) == 900
    for d in documents.values():
        run = d["runs"][0]
        ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
        used = [r["ruleId"] for r in run["results"]]
        assert ids == list(dict.fromkeys(used)) and d["version"] == "2.1.0"  # in order of first use
        for result in run["results"]:
            assert ids[result["ruleIndex"]] == result["ruleId"] and "auditframe/v1" in result["partialFingerprints"]
    first = whole(R.sarif_lines(C.reported(_issues(spark))))["r"]["runs"][0]["results"][0]
    assert first["level"] == "error" and "region" not in first["locations"][0]["physicalLocation"]


def test_json_document(spark):
    state = _issues(spark)
    shown, verdicts = C.reported(state), C.verdicts(state)
    doc = whole(R.json_lines(shown, verdicts))["r"]
    levels = {"critical": 1, "high": 10, "medium": 0, "low": 10}
    assert doc["failed"] and doc["summary"] == {"total": 21, "by_severity": levels, "by_category": {"dependency-cve": 1, "injection": 20}, "ai_relevant": 0}
    assert [f["severity"] for f in doc["findings"]] == ["critical"] + ["high"] * 10 + ["low"] * 10 and "raw" not in doc["findings"][0]


def test_json_says_what_ran_and_what_was_found_before(spark):
    state = _issues(spark)
    shown, verdicts = C.reported(state), C.verdicts(state)
    listing = spark.createDataFrame([("r", "package.json", '{"engines": {"node": ">=18"}}'), ("r", "Dockerfile", "")], "repo string, path string, content string")
    reports = spark.createDataFrame(
        [("r", "semgrep", '{"version": "1.9"}', 0, 120), ("r", "bandit", "oops", 2, 30)], REPORTS + ", exit_code int, duration_ms int"
    )
    doc = whole(R.json_lines(shown, verdicts, P.repo_profile(listing), X.analyzer_status(reports, shown), P.node_constraint(listing),
                             min_confidence="high", baseline=True))["r"]
    assert doc["detection"]["stacks"] == ["node", "docker"] and doc["detection"]["node_constraint"] == ">=18 (package.json engines.node)"
    assert [(t["tool"], t["status"], t["findings"], t.get("version"), t["duration_ms"]) for t in doc["analyzers"]] == [
        ("bandit", "error", 0, None, 30), ("semgrep", "ok", 20, "1.9", 120),
    ]
    assert doc["baseline"] == {"new": 21, "known": 0} and doc["min_confidence"] == "high" and doc["min_confidence_filtered"] == 0


def test_markdown_file_is_in_order(spark, tmp_path):
    state = _issues(spark)
    shown, verdicts = C.reported(state), C.verdicts(state)
    statuses = X.analyzer_status(spark.createDataFrame([("r", "semgrep", "{}")], REPORTS), shown)
    path = str(tmp_path / "md")
    R.write_lines(R.render_report(shown, verdicts, "markdown", statuses=statuses), path)
    text = "".join(open(f).read() for f in sorted(glob.glob(path + "/repo=r/part-*")))
    lines = text.splitlines()
    assert lines[0] == "## Security scan" and lines[1].startswith("**Failed**")
    assert lines.index("<summary><strong>Critical</strong> (1)</summary>") < lines.index("<summary><strong>High</strong> (10)</summary>")
    assert "- **[injection]** `f1.py:2`: m\\|1 _(semgrep, high confidence)_" in lines
    assert lines[-1] == "| semgrep | ok | 20 |  |"
    for kind in R.FORMATS:
        assert R.render_report(shown, verdicts, kind).count() > 0


def test_baseline_round_trip(spark, tmp_path):
    state = _issues(spark)
    path = str(tmp_path / "baseline")
    assert read_baseline(spark, path) is None
    C.write_baseline(C.reported(state), path)
    assert D.new_findings(C.reported(state), read_baseline(spark, path)).isEmpty()


def test_findings_table_replaces_only_its_run_date(spark, tmp_path):
    path = str(tmp_path / "t")
    shown = C.reported(_issues(spark))
    C.write_findings(shown, path, "2024-01-01")
    C.write_findings(shown, path, "2024-01-02")
    C.write_findings(shown.limit(1), path, "2024-01-02")
    counts = spark.read.parquet(path).groupBy("run_date").count()
    assert rows(counts.selectExpr("CAST(run_date AS STRING) d", "count"), "d", "count") == [("2024-01-01", 21), ("2024-01-02", 1)]


def test_trufflehog_payloads_are_made_once(spark, capsys):
    """A payload that is derived is not derived again for a filter; empty and missing ones give nothing."""
    record = '{"DetectorName": "d", "Raw": "abcdefgh", "SourceMetadata": {"Data": {"Git": {"file": "a.py", "line": 3}}}}'
    rows = [("r", record), ("r", ""), ("r", None), ("s", "{broken\n\n" + record)]
    raw = spark.createDataFrame(rows, "repo string, said string")
    found = X.read_trufflehog(raw.select("repo", F.lit("trufflehog").alias("tool"), F.reverse(F.reverse("said")).alias("payload")))
    found.explain()
    assert capsys.readouterr().out.count("reverse(reverse(") == 1
    assert sorted(tuple(r) for r in found.select("repo", "rule_id", "file", "line").collect()) == [(r, "trufflehog.d", "a.py", 3) for r in ("r", "s")]


def test_sarif_rules_meet_every_block_of_a_report(spark, monkeypatch):
    """A rule is dealt to the blocks that use it and to no fixed number of copies; results are the same."""
    state = _issues(spark)

    def results():
        lines = R.sarif_lines(C.reported(state)).filter("section = 3").collect()
        return sorted((r.place, json.loads(r.text.lstrip(","))["ruleIndex"]) for r in lines)

    whole = results()
    monkeypatch.setattr(R, "_BLOCK", 2)
    assert results() == whole and len(whole) == 21
