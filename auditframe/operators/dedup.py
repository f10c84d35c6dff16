"""Cross-tool de-duplication and baseline comparison.

A group is one issue: same repository, file, line and category, whatever tool
found it; without a line the rule id joins the key. Groups are reduced with
partial aggregates only, so a group holding a third of all rows shrinks to one
row per task before anything is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import scalars as S
from auditframe.operators.joins import SPREAD, TASK

ISSUE = ["repo", "file", "line", "category", "issue_rule"]
# The rule of an issue without a line follows from the others.
SPOT = [*(c for c in ISSUE if c != "issue_rule"), "rule_id", "tool"]


def with_issue_rule(findings: DataFrame) -> DataFrame:
    return findings.withColumn("issue_rule", F.when(F.col("line").isNull(), F.col("rule_id")))


def _candidate(columns: list[str], keys: list[str]) -> Column:
    """Struct ordered from best to worst: confidence, severity, then a total order over all columns but the keys, which are equal."""
    rank = S.confidence_ord("confidence") * 10 + S.severity_ord("severity")
    first = [c for c in ("tool", "rule_id", "message", "file") if c not in keys]
    rest = [c for c in columns if c not in (*first, *keys)]
    return F.struct((-rank).alias("__rank"), *first, *rest)


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__") and c != "issue_rule"]


def _weights(df: DataFrame) -> DataFrame:
    """Give raw rows the counters that an earlier reduction would have left behind."""
    if "__n" in df.columns:
        return df
    agreed = F.col("agreed_tools") if "agreed_tools" in df.columns else F.lit(None).cast("array<string>")
    links = F.col("references") if "references" in df.columns else F.lit(None).cast("array<string>")
    return df.withColumns(
        {
            "__n": F.lit(1).cast("long"),
            "__top": S.severity_ord("severity"),
            "__agreed": agreed,
            "__links": links,
        }
    )


def reduce_groups(findings: DataFrame, keys: list[str], stages: list[str] | None = None) -> DataFrame:
    """One row per key: best candidate, highest severity, united tools and links, row count.

    With ``stages`` the rows carry a ``stage``; only ``kept`` rows are merged
    and every stage's rows are counted in ``n_<stage>``, all in one grouping.
    """
    rows = _weights(with_issue_rule(findings) if "issue_rule" not in findings.columns else findings)
    columns = [c for c in _columns(rows) if c != "stage"]

    def live(c: Column) -> Column:
        return F.when(F.col("stage") == "kept", c) if stages else c

    counts = [
        F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("__n"))), F.lit(0)).alias(f"n_{s}") for s in stages or []
    ]
    tool_is_key = "tool" in keys and not stages
    grouped = rows.groupBy(*keys).agg(
        F.min(live(_candidate(columns, keys))).alias("best"),
        F.max(live(F.col("__top"))).alias("__top"),
        F.sum(live(F.col("__n"))).alias("__n"),
        *([] if tool_is_key else [F.collect_set(live(F.col("tool"))).alias("tools")]),
        F.array_distinct(F.flatten(F.collect_set(live(F.col("__agreed"))))).alias("__agreed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(live(F.col("__links")))))).alias("__links"),
        *counts,
    )
    tools = F.array_compact(F.array("tool")) if tool_is_key else F.col("tools")
    united = F.array_union(tools, "__agreed")
    # A key without a live row still names its place, so its counts find their repository.
    shown = [F.col(c) if c in keys else F.col("best")[c].alias(c) for c in columns]
    return grouped.select(
        *shown,
        *[F.col(c) for c in ("issue_rule", SPREAD, TASK) if c in keys],
        "__top", F.coalesce("__n", F.lit(0)).alias("__n"), united.alias("__agreed"), "__links",
        *[f"n_{s}" for s in stages or []],
    )


def collapse_copies(findings: DataFrame) -> DataFrame:
    """First reduction: same issue, rule and tool. Later filters on those columns stay exact.

    Its result feeds :func:`merge_issues`; per-row counts and unions travel along.
    """
    return reduce_groups(findings, SPOT)


def merge_issues(findings: DataFrame, stages: list[str] | None = None, spread: bool = False) -> DataFrame:
    """Final reduction to one row per issue.

    A group of one row is untouched. A larger one takes its best candidate,
    the group's highest severity, the sorted tools and the united links.
    With ``spread`` rows carry a ``SPREAD`` that follows from their issue, maybe its ``TASK`` too, and keep them.
    """
    place = [c for c in (SPREAD, TASK) if spread and c in findings.columns]
    merged = reduce_groups(findings, [*ISSUE, *place], stages)
    many = F.col("__n") > 1
    out = merged.withColumn("severity", F.when(many, S.severity_name("__top")).otherwise(F.col("severity")))
    if "agreed_tools" not in out.columns:
        out = out.withColumn("agreed_tools", F.lit(None).cast("array<string>"))
    out = out.withColumn(
        "agreed_tools", F.when(many, F.array_sort("__agreed")).otherwise(F.col("agreed_tools"))
    )
    if "references" in out.columns:
        out = out.withColumn(
            "references", F.when(many & (F.size("__links") > 0), F.col("__links")).otherwise(F.col("references"))
        )
    return out.drop("issue_rule", "__top", "__n", "__agreed", "__links")


def dedup(findings: DataFrame) -> DataFrame:
    return merge_issues(findings)


def duplicates_removed(findings: DataFrame) -> DataFrame:
    """Rows that :func:`dedup` folds into others, per repository."""
    sizes = with_issue_rule(findings).groupBy(*ISSUE).agg(F.count("*").alias("n"))
    return sizes.groupBy("repo").agg(F.sum(F.col("n") - 1).alias("duplicates_removed"))


# --- baseline --------------------------------------------------------------


def build_baseline(findings: DataFrame) -> DataFrame:
    """Distinct fingerprints per repository."""
    return findings.select("repo", S.fingerprint().alias("fingerprint")).distinct()


def mark_known(findings: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Add ``fingerprint`` and ``known``. Without a baseline nothing is known."""
    marked = findings.withColumn("fingerprint", S.fingerprint())
    if baseline is None:
        return marked.withColumn("known", F.lit(False))
    # An equi join on fine keys: neither side has hot ones, and the baseline grows with the findings.
    keys = baseline.select("repo", "fingerprint").distinct().withColumn("__known", F.lit(True))
    joined = marked.join(keys, ["repo", "fingerprint"], "left")
    return joined.withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known")


def new_findings(findings: DataFrame, baseline: DataFrame | None) -> DataFrame:
    return mark_known(findings, baseline).filter(~F.col("known")).drop("known", "fingerprint")


def known_findings(findings: DataFrame, baseline: DataFrame | None) -> DataFrame:
    return mark_known(findings, baseline).filter(F.col("known")).drop("known", "fingerprint")
