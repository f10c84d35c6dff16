"""Directives in source comments.

``audit-disable`` and ``audit-disable-file`` cover the file, ``-line`` its own
line, ``-next-line`` the line below. Ids after the keyword (rule, category or
tool, separated by commas or blanks) narrow it; without ids everything matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.operators.joins import SPREAD, SPREADS, TASK, by_spread, in_file, salted_join, spread_of
from auditframe.sources.files import LINE_BREAK

# Fixed value: directive grammar; group 1 is the scope, group 2 the ids.
DIRECTIVE_PATTERN = (
    r"(?i)" + V.DIRECTIVE + r"(-next-line|-line|-file)?(?:[ \t:]+([^\r\n*]*?))?(?:\s*(?:\*/|-->|$))"
)


def directive_entries(content: str | Column = "content") -> Column:
    """array<struct<line, ids>> of one file's text; line 0 is the whole file, null ids are all ids."""

    def entry(text: Column, i: Column) -> Column:
        scope = F.lower(F.regexp_extract(text, DIRECTIVE_PATTERN, 1))
        ids = F.filter(F.split(F.lower(F.regexp_extract(text, DIRECTIVE_PATTERN, 2)), r"[,\s]+"), lambda x: x != "")
        line = F.when(scope == "-line", i + 1).when(scope == "-next-line", i + 2).otherwise(F.lit(0))
        return F.when(
            text.contains(V.DIRECTIVE) | F.lower(text).contains(V.DIRECTIVE),
            F.when(
                text.rlike(DIRECTIVE_PATTERN),
                F.struct(line.alias("line"), F.when(F.size(ids) > 0, ids).alias("ids")),
            ),
        )

    return F.array_compact(F.transform(F.split(S.col_of(content), LINE_BREAK, -1), entry))


def file_directives(files: DataFrame) -> DataFrame:
    """Files that carry directives, one row each; built inside the row, without a shuffle."""
    return files.filter(F.col("content").contains(V.DIRECTIVE)).select(
        "repo", "path", directive_entries().alias("directives")
    )


def merged_directives(files: DataFrame) -> DataFrame:
    """Directives per file and line: ids united, null (= all) absorbs every id."""
    rows = file_directives(files).select("repo", "path", F.inline_outer("directives")).filter(F.col("line").isNotNull())
    return rows.groupBy("repo", "path", "line").agg(
        F.when(
            ~F.bool_or(F.col("ids").isNull()),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))),
        ).alias("ids")
    )


def directive_hits() -> Column:
    """True when a row joined with its file's directives is covered by one of them."""
    names = F.array(F.lower("rule_id"), F.lower("category"), F.lower("tool"))
    return F.coalesce(
        F.exists(
            "directives",
            lambda d: ((d["line"] == 0) | F.coalesce(d["line"] == F.col("line"), F.lit(False)))
            & (d["ids"].isNull() | F.arrays_overlap(d["ids"], names)),
        ),
        F.lit(False),
    )


def _dealt(directives: DataFrame) -> DataFrame:
    """Directives by the ``SPREAD`` of the findings they may cover: those of a line go to one, those of a file to all of that file.

    A file has no row for a spread in which none may cover: the join that follows keeps findings without a partner.
    """
    covering = lambda i: F.filter("directives", lambda d: (d["line"] == 0) | (spread_of(d["line"]) == i))
    parts = F.transform(F.sequence(F.lit(0), F.lit(SPREADS - 1)), lambda i: F.struct(in_file(i).alias(SPREAD), covering(i).alias("directives")))
    covered = F.filter(parts, lambda p: F.size(p["directives"]) > 0)
    return directives.select("repo", "file", F.inline(covered))


def mark_inline(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``inline_suppressed``. Rows of one hot file are spread over several tasks.

    A ``SPREAD`` that findings carry is ``in_file(spread_of("line", ...))``, where what follows is null if there is a line.
    """
    directives = file_directives(files).withColumnRenamed("path", "file")
    if TASK in findings.columns:
        joined = findings.join(by_spread(_dealt(directives)), [TASK, "repo", "file", SPREAD], "left")
    elif SPREAD in findings.columns:
        joined = findings.join(_dealt(directives), ["repo", "file", SPREAD], "left")
    else:
        joined = salted_join(findings, directives, ["repo", "file"], ["line", "rule_id", "tool", "message"])
    return joined.withColumn("inline_suppressed", directive_hits()).drop("directives")


def drop_inline_suppressed(findings: DataFrame, files: DataFrame) -> DataFrame:
    return mark_inline(findings, files).filter(~F.col("inline_suppressed")).drop("inline_suppressed")
