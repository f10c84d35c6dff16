"""Coercion, filters, suppression, directives, merge, baseline on hand-written rows."""

import hashlib

from pyspark.sql import functions as F

from auditframe.functions import scalars as S
from auditframe.operators import dedup as D
from auditframe.operators import filters as P
from auditframe.operators import inline as L
from auditframe.operators import summary as M
from auditframe.operators import suppress as U
from auditframe.operators.findings import make_findings
from auditframe.plans import scan as C
from auditframe.session import stored
from auditframe.sources import files as X

COLUMNS = "repo string, tool string, rule_id string, severity string, category string, file string, line string, message string, confidence string"


def make(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return make_findings(df, **{c: c for c in df.columns})


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_coercion(spark):
    rows = [
        ("r", "semgrep", "x", "HIGH", "insecure-jwt", ".\\src\\auth\\jwt.js", "42", "  Weak\t ", "LOW"),
        ("r", None, None, "nope", "nope", None, "abc", "", "nope"),
    ]
    got = values(make(spark, rows), "tool", "severity", "category", "file", "line", "message", "confidence")
    assert got == [
        ("semgrep", "high", "insecure-jwt", "src/auth/jwt.js", 42, "Weak", "low"),
        ("unknown", "medium", "other", "", None, "Finding without a description.", "high"),
    ]


def test_numbers(spark):
    texts = ["7", " 7.9 ", "0", "-3", "1e2", "", "x", "12d", "NaN", "Infinity", "0.5", ".25", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lines = [r[0] for r in df.select(S.coerce_line("t")).collect()]
    assert lines == [7, 7, None, None, 100, None, None, None, None, None, 0, 0, None]
    columns = [r[0] for r in df.select(S.coerce_column("t")).collect()]
    assert columns == [7, 7, 0, None, 100, 0, None, None, None, None, 0, 0, None]


def test_fingerprint_matches_sha1(spark):
    got = one(spark, S.fingerprint(*[F.lit(x) for x in ("t", "r", "c", "f", " m ")]))
    assert got == hashlib.sha1("\0".join(["t", "r", "c", "f", "m"]).encode()).hexdigest()


def test_redaction(spark):
    assert one(spark, S.redact(F.lit(""))) == "[redacted]"
    assert one(spark, S.redact(F.lit("abcdef"))) == "******"
    assert one(spark, S.redact(F.lit("abcdefg"))) == "abc…[redacted, 7 chars]"


def test_path_classes(spark):
    kept = ["node_modules_backup/a.js", "bin/a.js", "dist/a.js", "src/latest.py", "a/contest.py"]
    for path in kept:
        assert not one(spark, S.is_vendored(F.lit(path)))
        assert not one(spark, S.is_test_file(F.lit(path)))
    for path in ["a\\node_modules\\b.js", "vendor", ".venv/x.py"]:
        assert one(spark, S.is_vendored(F.lit(path)))
    for path in ["test_a.py", "x/a_test.py", "conftest.py", "Tests/a.js", "a.spec.tsx", "a.test.mjs"]:
        assert one(spark, S.is_test_file(F.lit(path)))
    assert one(spark, S.is_data_file(F.lit("x/A.CSV"))) and not one(spark, S.is_data_file(F.lit("x/.csv")))


def test_import_candidates(spark):
    got = one(spark, S.import_candidates(F.lit("../lib/./x"), F.lit("src/a/b.js")))
    assert got[0] == "src/lib/x" and got[1] == "src/lib/x.js" and got[7] == "src/lib/x/index.js" and len(got) == 13
    assert one(spark, S.import_candidates(F.lit("./x"), F.lit("b.js")))[0] == "x"
    assert one(spark, S.import_candidates(F.lit("express"), F.lit("b.js"))) is None


def test_listing(spark):
    paths = ["src/a.JS", "build/a.js", "src/build", "a/b/c/d.js", "x/node_modules/y.js"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    assert values(X.list_files(df), "path") == [("a/b/c/d.js",), ("src/a.JS",), ("src/build",)]
    assert values(X.list_files(df, extensions=[".js"], max_depth=2), "path") == [("src/a.JS",)]


GLOBS = {
    "src/**": [("src/a.js", True), ("lib/src/a.js", False)],
    "*.min.js": [("x/y/a.min.js", True), ("a.js", False)],
    "/vendor/": [("vendor/a/b.c", True), ("x/vendor/a", False)],
    "a?c": [("x/abc/d", True), ("abbc", False)],
    "data/**/f.csv": [("data/f.csv", True), ("data/x/y/f.csv", True), ("data/f_csv", False)],
    "a+b(1).js": [("a+b(1).js", True), ("aab1.js", False)],
}


def test_globs(spark):
    for pattern, cases in GLOBS.items():
        for path, expected in cases:
            got = one(spark, F.rlike(F.lit(path), S.path_glob_regex(F.lit(pattern))))
            assert got == expected, (pattern, path)
    assert one(spark, F.rlike(F.lit("Rule.JWT.x"), S.rule_glob_regex(F.lit("rule.jwt.*"))))


def test_last_path_pattern_wins(spark):
    ignore = ["src/**", "!src/keep.js", "", "# note", "src/keep.js.bak", "rule: R.9*", "Category: Secrets"]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(ignore)], "repo string, ord int, line string")
    rows = [
        ("r", "t", "A", "low", "other", f, "1", "m", "high") for f in ["src/keep.js", "src/a.js", "lib/a.js", "src/keep.js.bak"]
    ]
    rows += [("r", "t", "r.91", "low", "other", "lib/b.js", "1", "m", "high"), ("r", "t", "A", "low", "secrets", "lib/c.js", "1", "m", "high")]
    rows += [("other", "t", "A", "low", "secrets", "src/a.js", "1", "m", "high")]
    out = U.mark_suppressed(make(spark, rows), U.parse_ignore_lines(lines))
    assert values(out.filter("suppressed_by IS NOT NULL"), "repo", "file", "suppressed_by") == [
        ("r", "lib/b.js", "rule"), ("r", "lib/c.js", "category"), ("r", "src/a.js", "path"), ("r", "src/keep.js.bak", "path"),
    ]
    assert out.count() == len(rows)


def test_directives(spark):
    text = "a // audit-disable-line\n// audit-disable-next-line R1, secrets\nb\nc # audit-disable-line bandit"
    files = spark.createDataFrame(
        [("r", "a.js", text), ("r", "b.js", "x\n/* audit-disable injection */"), ("r", "c.js", "nothing")],
        "repo string, path string, content string",
    )
    rows = [("r", "semgrep", rule, "low", cat, f, line, "m", "high") for rule, cat, f, line in [
        ("Z", "other", "a.js", "1"), ("R1", "other", "a.js", "3"), ("Z", "other", "a.js", "3"), ("Z", "secrets", "a.js", "3"),
        ("Z", "other", "a.js", "4"), ("Z", "injection", "b.js", None), ("Z", "other", "b.js", "1"), ("Z", "other", "c.js", "1"),
        ("Z", "other", "a.js", None),
    ]]
    kept = L.drop_inline_suppressed(make(spark, rows), files)
    assert values(kept.fillna(0, ["line"]), "file", "line", "rule_id", "category") == [
        ("a.js", 0, "Z", "other"), ("a.js", 3, "Z", "other"), ("a.js", 4, "Z", "other"), ("b.js", 1, "Z", "other"), ("c.js", 1, "Z", "other"),
    ]


def test_merge_escalates_and_keeps_advisories_apart(spark):
    rows = [
        ("r", "semgrep", "a", "medium", "injection", "f", "1", "m", "high"),
        ("r", "eslint", "b", "high", "injection", "f", "1", "m", "low"),
        ("r", "npm-audit", "CVE-1", "low", "dependency-cve", "p", None, "m", "high"),
        ("r", "npm-audit", "CVE-2", "low", "dependency-cve", "p", None, "m", "high"),
    ]
    out = D.dedup(make(spark, rows))
    merged = out.filter("line = 1").first()
    assert (merged.tool, merged.severity, merged.agreed_tools) == ("semgrep", "high", ["eslint", "semgrep"])
    assert out.count() == 3 and out.filter("agreed_tools IS NULL").count() == 2
    assert D.dedup(out).drop("agreed_tools").exceptAll(out.drop("agreed_tools")).isEmpty()


def test_merge_against_brute_force_with_a_hot_key(spark):
    """A third of the rows share one key; two-step and one-step reduction agree with plain Python."""
    names = ["low", "medium", "high", "critical"]
    conf = ["low", "medium", "high"]
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        rows.append((
            "hot" if hot else f"r{i % 5}", f"t{i % 7}", f"rule{i % 11}", names[i * 7 % 4], "injection",
            "f" if hot else f"f{i % 13}", "5" if hot or i % 4 else None, f"m{i % 3}", conf[i * 5 % 3],
        ))
    groups = {}
    for repo, tool, rule, sev, cat, file, line, msg, cf in rows:
        groups.setdefault((repo, file, line, cat, None if line else rule), []).append(
            (-(conf.index(cf) * 10 + 10 + names.index(sev) + 1), tool, rule, msg, cf, sev)
        )
    want = sorted(
        (k[0], k[1], int(k[2]) if k[2] else 0, min(g)[1], min(g)[2], max(names.index(x[5]) for x in g),
         ",".join(sorted({x[1] for x in g})) if len(g) > 1 else "")
        for k, g in groups.items()
    )
    df = make(spark, rows)
    for out in (D.dedup(df), D.merge_issues(D.collapse_copies(df))):
        got = out.select(
            "repo", "file", F.coalesce("line", F.lit(0)), "tool", "rule_id", S.severity_ord("severity") - 1,
            F.coalesce(F.array_join("agreed_tools", ","), F.lit("")),
        ).collect()
        assert sorted(map(tuple, got)) == want
    removed = D.duplicates_removed(df).agg(F.sum("duplicates_removed")).first()[0]
    assert removed == len(rows) - len(groups)


def test_data_file_policy(spark):
    rows = [
        ("r", "t", "a", "high", "secrets", "x.csv", "1", "m", "medium"),
        ("r", "t", "b", "critical", "secrets", "x.csv", "2", "m", "medium"),
        ("r", "t", "c", "high", "secrets", "x.csv", "3", "m", "high"),
        ("r", "t", "d", "high", "secrets", "x.py", "4", "m", "low"),
    ]
    df = make(spark, rows)
    demoted = P.apply_data_file_policy(df)
    assert values(demoted.filter("demoted_reason IS NOT NULL"), "rule_id", "severity", "confidence") == [("a", "low", "low")]
    assert P.apply_data_file_policy(df, "ignore").count() == 3
    assert P.apply_data_file_policy(df, "keep").filter("demoted_reason IS NOT NULL").count() == 0


def test_baseline_ignores_lines(spark):
    old = make(spark, [("r", "t", "a", "low", "other", "f", "1", "same", "high")])
    now = make(spark, [("r", "t", "a", "low", "other", "f", "99", "same", "high"), ("r", "t", "a", "low", "other", "f", "9", "new", "high")])
    baseline = D.build_baseline(old)
    assert values(D.known_findings(now, baseline), "line") == [(99,)]
    assert values(D.new_findings(now, baseline), "line") == [(9,)]
    assert D.new_findings(now, None).count() == 2


def test_gate(spark):
    df = make(spark, [("a", "t", "a", "high", "other", "f", "1", "m", "high"), ("b", "t", "a", "low", "other", "f", "1", "m", "high")])
    everyone = spark.createDataFrame([("a",), ("b",), ("c",)], "repo string")
    assert values(M.gate(df, "High", everyone=everyone), "repo", "failed") == [("a", True), ("b", False), ("c", False)]
    assert values(M.gate(df, "typo"), "failed") == [(False,), (False,)]
    assert values(M.gate(df, "low", updating_baseline=True), "failed") == [(False,), (False,)]


def test_merge_comes_before_demotion(spark):
    """A data-file secret that a certain tool also reports stays loud."""
    rows = [
        ("r", "trufflehog", "x", "high", "secrets", "d.csv", "1", "m", "medium"),
        ("r", "gitleaks", "y", "high", "secrets", "d.csv", "1", "m", "high"),
        ("r", "trufflehog", "x", "high", "secrets", "d.csv", "2", "m", "medium"),
    ]
    out = C.issues(make(spark, rows))
    assert values(out, "line", "severity", "confidence") == [(1, "high", "high"), (2, "low", "low")]


def test_counters_add_up(spark):
    rows = [("r", "t", f"R{i % 4}", "high", "other", f, "1", "m", "high") for i in range(40) for f in ["node_modules/a", "src/a", "lib/a"]]
    ignore = spark.createDataFrame([("r", 1, "lib/**")], "repo string, ord int, line string")
    state = C.issues(make(spark, rows), ignore)
    verdict = C.verdicts(state, "high").first()
    assert (verdict.vendored, verdict.ignored, verdict.duplicates_removed, verdict.total) == (40, 40, 39, 1)
    assert verdict.failed
    lean = C.issues(make(spark, rows), ignore, count_dropped=False)
    assert values(C.reported(lean), "file", "rule_id") == values(C.reported(state), "file", "rule_id")


def test_directives_and_merge_share_one_exchange(spark, capsys):
    """Findings go from the join with directives to the merge without another exchange, and nothing changes by it."""
    rows = [("r", t, f"R{i % 3}", f"a{i % 2}.py", i % 5 or None) for i in range(60) for t in ("x", "y")]
    found = make_findings(
        spark.createDataFrame(rows, "repo string, tool string, rule_id string, file string, line int"),
        repo="repo", tool="tool", rule_id="rule_id", file="file", line="line", severity=F.lit("high"), category=F.lit("injection"), message=F.lit("m"),
    )
    texts = [("r", "a0.py", "x\ny  # audit-disable-line R1"), ("r", "a1.py", "# audit-disable-file y\nz  # audit-disable-next-line")]
    files = spark.createDataFrame(texts, "repo string, path string, content string")
    issues = C.issues(found, files=files)
    issues.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning(repo") == 3  # copies, findings and directives
    kept = L.drop_inline_suppressed(found, files)
    merged = D.dedup(kept).select("repo", "file", "line", "rule_id", "tool", "agreed_tools")
    shown = C.reported(issues).select(merged.columns)
    assert sorted(map(str, shown.collect())) == sorted(map(str, merged.collect()))
    assert issues.agg(F.sum("n_inline")).first()[0] == found.count() - kept.count()


def test_ignore_lists_directives_and_merge_share_one_exchange(spark, capsys):
    """After copies are collapsed findings move once, whatever joins they meet before the merge, and nothing changes by it."""
    rows = [(r, t, f"R{i % 3}", f"a{i % 4}.py", i % 5 or None) for i in range(120) for r in ("r", "s", None) for t in ("x", "y")]
    found = make_findings(
        spark.createDataFrame(rows, "repo string, tool string, rule_id string, file string, line int"),
        repo="repo", tool="tool", rule_id="rule_id", file="file", line="line", severity=F.lit("high"), category=F.lit("injection"), message=F.lit("m"),
    )
    texts = [("r", "a0.py", "x\ny  # audit-disable-line R1"), ("s", "a1.py", "# audit-disable-file y\nz  # audit-disable-next-line"), (None, "a1.py", "# audit-disable")]
    files = spark.createDataFrame(texts, "repo string, path string, content string")
    ignore = spark.createDataFrame([("r", 1, "a2*"), ("r", 2, "rule:R2"), ("s", 1, "a3.py"), (None, 1, "*")], "repo string, ord int, line string")
    issues = C.issues(found, ignore, files)
    issues.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange shufflepartitionidpassthrough") == 3  # findings, ignore lists and directives
    assert plan.count("Exchange hashpartitioning(repo") == 2  # copies, and the lines of a list
    unsuppressed = U.mark_suppressed(found, U.parse_ignore_lines(ignore)).filter("suppressed_by IS NULL").drop("suppressed_by")
    kept = L.drop_inline_suppressed(unsuppressed, files)
    merged = D.dedup(kept).select("repo", "file", "line", "rule_id", "tool", "agreed_tools")
    assert sorted(map(str, C.reported(issues).select(merged.columns).collect())) == sorted(map(str, merged.collect()))
    counted = issues.agg(F.sum("n_ignored"), F.sum("n_inline")).first()
    assert tuple(counted) == (found.count() - unsuppressed.count(), unsuppressed.count() - kept.count())


def test_reported_rows_need_no_dropped_ones(spark):
    """Issues that are dropped anyway need not meet the baseline, stored or not."""
    rows = [("r", "t", f"R{i % 4}", "high", "other", f, str(i), f"m{i % 6}", "low" if i % 5 == 0 else "high") for i in range(1, 40) for f in ("node_modules/a", "src/a")]
    found = make(spark, rows)
    baseline = D.build_baseline(found.filter("message = 'm1'"))
    whole = C.issues(found, min_confidence="medium", baseline=baseline)
    want = sorted(map(str, C.reported(whole).collect()))
    lean = C.issues(found, min_confidence="medium", baseline=baseline, with_dropped=False)
    assert sorted(r.dropped_by or "" for r in lean.select("dropped_by").distinct().collect()) == ["", "known"]
    assert sorted(map(str, C.reported(lean).collect())) == want and want
    held = C.issues(found, min_confidence="medium", baseline=baseline, store=True)
    assert sorted(map(str, held.collect())) == sorted(map(str, whole.collect()))


def test_stored_rows_come_back(spark):
    """A stored table gives its rows again, and the session keeps its settings."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    df = spark.createDataFrame([("a", [1, None], None), (None, None, True)] * 50, "s string, l array<int>, b boolean").repartition(3)
    again = stored(df)
    assert again.columns == df.columns and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    assert again.inputFiles() and spark.conf.get(name, None) == before


def test_directives_are_dealt_only_where_they_may_cover(spark):
    """A line's directive goes to one spread, a file's to all; other spreads get no row."""
    files = spark.createDataFrame([("r", "a", "x // audit-disable-line"), ("r", "b", "/* audit-disable injection */")], "repo string, path string, content string")
    dealt = L._dealt(L.file_directives(files).withColumnRenamed("path", "file")).collect()
    assert sorted(r.file for r in dealt) == ["a"] + ["b"] * L.SPREADS
