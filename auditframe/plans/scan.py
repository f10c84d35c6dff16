"""The whole chain from raw findings to a verdict per repository.

Order matters and is fixed: vendored, ignore lists, inline directives, merge
across tools, data-file policy, test noise, minimum confidence, baseline.

Shape of the plan: one exchange collapses copies of a finding (partial
aggregates first, so hot spots shrink before they travel), a second one lays
the collapsed rows out for ignore lists, directives, the merge of tools per
issue and settings, a third one meets the baseline, and verdicts are one small
aggregate per repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.operators import dedup as D
from auditframe.operators import filters as P
from auditframe.operators import inline as I
from auditframe.operators import suppress as U
from auditframe.operators.summary import report_order
from auditframe.operators.joins import SPREAD, TASK, by_spread, for_all_spreads, in_file, salted_join, spread_of
from auditframe.session import durable, stored
from auditframe.sources.config import repo_settings, with_config_ignores

STAGES = ["vendored", "ignored", "inline", "kept"]


def stage_findings(
    findings: DataFrame,
    ignore_lines: DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """Collapsed findings with the ``stage`` that drops them, or ``kept``."""
    # One exchange serves ignore lists, directives and the merge that follows: whatever belongs to one issue has one spread.
    rows = D.collapse_copies(findings)
    rows = rows.withColumn(SPREAD, in_file(spread_of("line", F.when(F.col("line").isNull(), F.col("rule_id")))))
    if ignore_lines is not None:
        rows = by_spread(rows)
    rows = rows.withColumn("stage", F.when(P.vendored(), F.lit("vendored")))
    if ignore_lines is not None:
        rows = U.mark_suppressed(rows, U.parse_ignore_lines(ignore_lines))
        rows = rows.withColumn(
            "stage", F.coalesce("stage", F.when(F.col("suppressed_by").isNotNull(), F.lit("ignored")))
        ).drop("suppressed_by")
    if files is not None:
        rows = I.mark_inline(rows, files)
        rows = rows.withColumn(
            "stage", F.coalesce("stage", F.when(F.col("inline_suppressed"), F.lit("inline")))
        ).drop("inline_suppressed")
    return rows.withColumn("stage", F.coalesce("stage", F.lit("kept")))


def issues(
    findings: DataFrame,
    ignore_lines: DataFrame | None = None,
    files: DataFrame | None = None,
    *,
    data_files: str = "demote",
    min_confidence: str | None = None,
    baseline: DataFrame | None = None,
    count_dropped: bool = True,
    config: DataFrame | None = None,
    with_dropped: bool = True,
    store: bool = False,
) -> DataFrame:
    """One row per issue with everything later steps need.

    ``config`` (from ``overlay_config``) sets the data-file policy and further ignore lines per repository;
    repositories it does not know follow ``data_files``.

    ``dropped_by`` tells why a row is not reported (null: reported), ``n_*``
    count the raw rows per stage, ``known`` comes from the baseline. Without
    ``count_dropped`` vendored rows are filtered in the scan and never travel.
    Without ``with_dropped`` issues dropped before the baseline is asked are
    left out and do not travel to it; :func:`reported` gives the same rows.
    With ``store`` merged rows are stored before the baseline is asked: what
    was shuffled for them is gone by then. For callers that need every column.
    """
    rows = findings if count_dropped else P.drop_vendored(findings)
    if config is not None and ignore_lines is not None:
        ignore_lines = with_config_ignores(ignore_lines, config)
    staged = stage_findings(rows, ignore_lines, files)
    if not count_dropped:
        staged = staged.filter(F.col("stage") == "kept")
    merged = D.merge_issues(staged, STAGES, spread=True)
    hit = P.unsure_data_secret()
    if config is not None:
        settings = repo_settings(config).select("repo", F.col("data_files").alias("__policy"))
        if TASK in merged.columns:
            merged = merged.join(for_all_spreads(settings), [TASK, "repo", SPREAD], "left")
        else:
            merged = salted_join(merged, settings, ["repo"], ["file", "rule_id", "line", "message"])
        policy, low = F.coalesce("__policy", F.lit(data_files)), F.lit("low")
        merged = merged.withColumns({"data_ignored": hit & (policy == "ignore"), "__low": hit & ~policy.isin("ignore", "keep")})
        merged = merged.withColumns(
            {
                "severity": F.when(F.col("__low"), low).otherwise(F.col("severity")),
                "confidence": F.when(F.col("__low"), low).otherwise(F.col("confidence")),
                "demoted_reason": F.when(F.col("__low"), F.lit("data-file")),
            }
        ).drop("__low", "__policy")
    elif data_files == "ignore":
        merged = merged.withColumns({"data_ignored": hit, "demoted_reason": F.lit(None).cast("string")})
    else:
        merged = P.apply_data_file_policy(merged, data_files).withColumn("data_ignored", F.lit(False))
    merged = merged.withColumn(
        "dropped_by",
        F.when(F.col("n_kept") == 0, F.lit("suppressed"))
        .when(F.col("data_ignored"), F.lit("data-file"))
        .when(P.test_assert_noise(), F.lit("test-assert"))
        .when(~P.at_least_confidence(min_confidence), F.lit("confidence")),
    ).drop("data_ignored", SPREAD, TASK)
    if not with_dropped:
        merged = merged.filter(F.col("dropped_by").isNull())
    if store:
        merged = stored(merged)
    marked = D.mark_known(merged, baseline)
    return marked.withColumn(
        "dropped_by", F.when(F.col("dropped_by").isNull() & F.col("known"), F.lit("known")).otherwise(F.col("dropped_by"))
    )


def reported(issue_rows: DataFrame) -> DataFrame:
    """Findings that are left, unsorted."""
    return issue_rows.filter(F.col("dropped_by").isNull()).drop("dropped_by", "known", *[f"n_{s}" for s in STAGES])


def _count_if_dropped(reason: str, name: str):
    return F.count_if(F.coalesce(F.col("dropped_by") == reason, F.lit(False))).alias(name)


def drop_counters(issue_rows: DataFrame) -> DataFrame:
    """How many rows each step removed, per repository."""
    return issue_rows.groupBy("repo").agg(*_counters())


def _counters():
    return [
        F.sum("n_vendored").alias("vendored"),
        F.sum("n_ignored").alias("ignored"),
        F.sum("n_inline").alias("inline_suppressed"),
        F.sum(F.greatest(F.col("n_kept") - 1, F.lit(0))).alias("duplicates_removed"),
        F.count_if(F.col("demoted_reason").isNotNull()).alias("demoted"),
        _count_if_dropped("data-file", "data_ignored"),
        _count_if_dropped("test-assert", "test_asserts"),
        _count_if_dropped("confidence", "below_confidence"),
        _count_if_dropped("known", "known"),
    ]


def verdicts(
    issue_rows: DataFrame,
    fail_on: str = "critical",
    updating_baseline: bool = False,
    everyone: DataFrame | None = None,
    config: DataFrame | None = None,
) -> DataFrame:
    """One row per repository: totals per severity, drop counters, ``failed``.

    ``everyone`` lists the repositories that were scanned; those without a finding get zeros and do not fail.
    ``config`` (from ``overlay_config``) sets the threshold per repository, else it is ``fail_on``.
    """
    shown = F.col("dropped_by").isNull()
    levels = [F.count_if(shown & (F.col("severity") == s)).alias(s) for s in reversed(V.SEVERITIES)]
    reached = F.lit(False) if updating_baseline else S.meets_threshold("severity", fail_on)
    found = issue_rows.groupBy("repo").agg(
        F.count_if(shown).alias("total"),
        *levels,
        F.count_if(shown & F.col("ai_relevant")).alias("ai_relevant"),
        *_counters(),
        F.bool_or(F.coalesce(shown & reached, F.lit(False))).alias("failed"),
    )
    if config is not None:
        settings = repo_settings(config).select("repo", "fail_on")
        level = S.severity_ord(F.coalesce("fail_on", F.lit(fail_on.lower())))
        worst = F.greatest(*[F.when(F.col(s) > 0, n).otherwise(0) for s, n in V.SEVERITY_ORD.items()])
        failed = F.lit(False) if updating_baseline else (level > 0) & (worst >= level)
        found = found.join(settings, "repo", "left").withColumn("failed", failed).drop("fail_on")
    if everyone is None:
        return found
    return everyone.select("repo").distinct().join(found, "repo", "left").na.fill(0).na.fill(False)


def write_findings(findings: DataFrame, path: str, run_date: str) -> None:
    """Append-safe findings table: one run date is one partition, ordered inside its files."""
    # Stored first: range partitioning samples its input, which would compute the findings twice.
    out = durable(findings.withColumn("run_date", F.lit(run_date)))
    ordered = out.repartitionByRange(F.col("repo"), *report_order()).sortWithinPartitions("repo", *report_order())
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def write_baseline(findings: DataFrame, path: str) -> None:
    D.build_baseline(findings).write.mode("overwrite").parquet(path)
