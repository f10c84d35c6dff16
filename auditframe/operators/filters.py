"""Row filters and the data-file policy. All are narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S


def vendored(file: str | Column = "file") -> Column:
    return S.is_vendored(file)


def drop_vendored(findings: DataFrame) -> DataFrame:
    """Remove findings inside third-party or generated directories."""
    return findings.filter(~vendored())


def unsure_data_secret() -> Column:
    """A secret in a data file that is neither critical nor certain."""
    return (
        (F.col("category") == "secrets")
        & (F.col("severity") != "critical")
        & (F.col("confidence") != "high")
        & S.is_data_file("file")
    )


def apply_data_file_policy(findings: DataFrame, policy: str = "demote") -> DataFrame:
    """``demote`` unsure data-file secrets to low, ``ignore`` them, or ``keep`` them as they are.

    Any other policy means ``demote``. The result has a ``demoted_reason``.
    """
    no_reason = F.lit(None).cast("string")
    if policy == "keep":
        return findings.withColumn("demoted_reason", no_reason)
    hit = unsure_data_secret()
    if policy == "ignore":
        return findings.filter(~hit).withColumn("demoted_reason", no_reason)
    marked = findings.withColumn("__hit", hit)
    low = F.lit("low")
    return marked.withColumns(
        {
            "severity": F.when(F.col("__hit"), low).otherwise(F.col("severity")),
            "confidence": F.when(F.col("__hit"), low).otherwise(F.col("confidence")),
            "demoted_reason": F.when(F.col("__hit"), F.lit("data-file")),
        }
    ).drop("__hit")


def test_assert_noise() -> Column:
    """An assert check inside a test file."""
    rule = F.col("rule_id")
    return (rule.rlike("(?i)assert_used") | rule.rlike(r"\bB101\b")) & S.is_test_file("file")


def drop_test_asserts(findings: DataFrame) -> DataFrame:
    return findings.filter(~test_assert_noise())


def at_least_confidence(minimum: str | None) -> Column:
    """True for everything when the minimum is unset or unknown."""
    level = V.CONFIDENCE_ORD.get((minimum or "").lower())
    return F.lit(True) if level is None else S.confidence_ord("confidence") >= level


def keep_confident(findings: DataFrame, minimum: str | None) -> DataFrame:
    return findings.filter(at_least_confidence(minimum))
