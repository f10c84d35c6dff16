"""The findings relation: one schema every source is brought into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe import vocabulary as V
from auditframe.functions import scalars as S

FINDING = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("ai_relevant", T.BooleanType()),
        T.StructField("remediation", T.StringType()),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("tool_version", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("agreed_tools", T.ArrayType(T.StringType())),
    ]
)
COLUMNS = FINDING.fieldNames()


def make_findings(df: DataFrame, keep: list[str] | None = None, **fields: Column | str | None) -> DataFrame:
    """Project ``df`` to coerced findings.

    Each keyword names a finding column and the expression it comes from.
    Bad values fall back to defaults, nothing throws. Columns in ``keep`` pass
    through unchanged.
    """

    def given(name: str) -> Column:
        value = fields.get(name)
        kind = "array<string>" if name in ("references", "agreed_tools") else "string"
        return F.lit(None).cast(kind) if value is None else S.col_of(value)

    # First the plain values, then whatever refers to a value twice: the
    # optimiser keeps the two steps apart, so nothing is computed twice.
    plain = {
        "tool": F.coalesce(given("tool").cast("string"), F.lit("unknown")),
        "rule_id": F.coalesce(given("rule_id").cast("string"), F.lit("unknown")),
        "severity": S.coerce_severity(given("severity")),
        "category": S.coerce_category(given("category")),
        "file": S.normalize_path(given("file")),
        "line": S.coerce_line(given("line")),
        "end_line": S.coerce_line(given("end_line")),
        "column": S.coerce_column(given("column")),
        "message": S.strip(given("message").cast("string")),
        "confidence": S.coerce_confidence(given("confidence")),
        "ai_relevant": F.coalesce(given("ai_relevant").cast("boolean"), F.lit(False)),
        "agreed_tools": F.array_distinct(given("agreed_tools")),
    }
    first = df.select(*(keep or []), *[plain.get(c, given(c)).alias(c) for c in COLUMNS])

    def filled(name: str) -> Column:
        c = F.col(name)
        if fields.get(name) is None:
            return c
        return F.when(F.size(c) > 0, c) if name in ("references", "agreed_tools") else S.nonempty(c)

    refined = {c: filled(c).alias(c) for c in ("remediation", "references", "tool_version", "agreed_tools")}
    refined["message"] = F.coalesce(S.nonempty("message"), F.lit(V.EMPTY_MESSAGE)).alias("message")
    return first.select(*(keep or []), *[refined.get(c, F.col(c)) for c in COLUMNS])


def concat_findings(*parts: DataFrame) -> DataFrame:
    """All findings of all analyzers."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
