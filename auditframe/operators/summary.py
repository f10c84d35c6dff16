"""Counts, gate, order and analyzer selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S


def summarize(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals per repository, zero-filled for every severity."""
    per_level = [F.count_if(F.col("severity") == s).alias(s) for s in reversed(V.SEVERITIES)]
    return findings.groupBy(*(keys or ["repo"])).agg(
        F.count("*").alias("total"), *per_level, F.count_if("ai_relevant").alias("ai_relevant")
    )


def summarize_categories(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "category").agg(F.count("*").alias("findings"))


def gate(
    findings: DataFrame,
    fail_on: str = "critical",
    keys: list[str] | None = None,
    everyone: DataFrame | None = None,
    updating_baseline: bool = False,
) -> DataFrame:
    """``failed`` per key. ``everyone`` lists keys that must appear even without findings.

    A run that records a baseline never fails.
    """
    keys = keys or ["repo"]
    reached = F.lit(False) if updating_baseline else S.meets_threshold("severity", fail_on)
    result = findings.groupBy(*keys).agg(F.bool_or(reached).alias("failed"))
    if everyone is None:
        return result
    return everyone.select(*keys).distinct().join(result, keys, "left").withColumn(
        "failed", F.coalesce("failed", F.lit(False))
    )


def report_order() -> list[Column]:
    """Severity, confidence, file, line, tool; the rest makes the order total."""
    return [
        S.severity_ord("severity").desc(),
        S.confidence_ord("confidence").desc(),
        F.col("file"),
        F.coalesce("line", F.lit(0)),
        F.col("tool"),
        F.col("rule_id"),
        F.col("category"),
        F.col("message"),
    ]


def sort_findings(findings: DataFrame) -> DataFrame:
    """Global report order: a range-partitioned sort."""
    return findings.orderBy(*report_order())


def top_findings(findings: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The first ``n`` findings of each key in report order, with their ``position``.

    The rank limit is pushed below the exchange, so a task never sends more
    than ``n`` rows of one key.
    """
    order = W.partitionBy(*(keys or ["repo"])).orderBy(*report_order())
    return findings.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def select_analyzers(
    profiles: DataFrame,
    settings: DataFrame | None = None,
    only: list[str] | None = None,
    skip: list[str] | None = None,
) -> DataFrame:
    """Analyzers to run per repository: ``(repo, analyzer)``.

    ``profiles(repo, enabled_tools, languages)``; ``settings(repo, enabled,
    disabled)`` from configuration. ``only`` overrides detection; ``enabled``
    replaces the detected scanners; ``disabled`` and ``skip`` always remove.
    """
    def names(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    rows = profiles.select("repo", "enabled_tools", "languages")
    if settings is None:
        rows = rows.withColumns({"enabled": names([]), "disabled": names([])})
    else:
        rows = rows.join(settings.select("repo", "enabled", "disabled"), "repo", "left").withColumns(
            {c: F.coalesce(c, names([])) for c in ("enabled", "disabled")}
        )
    if only:
        chosen = names([a for a in V.SCANNERS + V.CHECKS if a in set(only)])
    else:
        scanners = F.when(
            F.size("enabled") > 0, F.array_intersect("enabled", names(V.SCANNERS))
        ).otherwise(F.col("enabled_tools"))
        web = F.arrays_overlap("languages", names(["javascript", "python"]))
        chosen = F.concat(scanners, F.when(web, names(V.CHECKS)).otherwise(names([])))
    removed = F.concat(F.col("disabled"), names(skip or []))
    return rows.select("repo", F.explode(F.array_except(chosen, removed)).alias("analyzer"))
