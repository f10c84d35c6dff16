"""Ignore lists: path patterns (last match wins), rule patterns, categories.

``ignore_lines(repo, ord, line)`` -> ``suppressions(repo, ord, kind, value, regex, negated)``
-> one compiled row per repository, evaluated next to each finding. No pair of
finding and pattern is ever materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import scalars as S
from auditframe.operators.joins import SPREAD, TASK, for_all_spreads, salted_join


def parse_ignore_lines(ignore_lines: DataFrame) -> DataFrame:
    """Classify each line; comments, blanks and empty values are skipped."""
    text = S.strip("line")
    low = F.lower(text)
    is_rule, is_category, is_path = (low.startswith(p) for p in ("rule:", "category:", "path:"))
    typed = ignore_lines.filter((text != "") & ~text.startswith("#")).select(
        "repo",
        "ord",
        F.when(is_rule, F.lit("rule")).when(is_category, F.lit("category")).otherwise(F.lit("path")).alias("kind"),
        F.when(is_rule | is_path, S.strip(F.substr(text, F.lit(6))))
        .when(is_category, F.lower(S.strip(F.substr(text, F.lit(10)))))
        .otherwise(text)
        .alias("value"),
    ).filter(F.col("value") != "")
    path = typed["kind"] == "path"
    negated = path & typed["value"].startswith("!")
    body = F.when(negated, F.substr(typed["value"], F.lit(2))).otherwise(typed["value"])
    return typed.select(
        "repo",
        "ord",
        "kind",
        "value",
        F.when(path, S.path_glob_regex(body))
        .when(typed["kind"] == "rule", S.rule_glob_regex(typed["value"]))
        .alias("regex"),
        negated.alias("negated"),
    )


def _merge_runs(patterns: Column) -> Column:
    """Join neighbours of one polarity into a single alternation, keeping the order of runs."""
    start = F.array().cast("array<struct<negated:boolean,regex:string>>")

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(
            p["negated"].alias("negated"), F.concat(last["regex"], F.lit("|"), p["regex"]).alias("regex")
        )
        alone = F.struct(p["negated"].alias("negated"), p["regex"].alias("regex"))
        same = (F.size(acc) > 0) & (last["negated"] == p["negated"])
        return F.when(
            same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))
        ).otherwise(F.array_append(acc, alone))

    return F.aggregate(patterns, start, step)


def compile_suppressions(suppressions: DataFrame) -> DataFrame:
    """One row per repository: path runs, one rule regex, category set.

    A repository has one ignore list, a small text file, so a row holds what
    that file held.
    """
    is_path = F.col("kind") == "path"
    entry = F.struct("ord", "negated", F.concat(F.lit("(?:"), "regex", F.lit(")")).alias("regex"))
    return (
        suppressions.groupBy("repo")
        .agg(
            F.array_sort(F.collect_list(F.when(is_path, entry))).alias("paths"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "rule", F.col("regex")))), "|").alias("rule_regex"),
            F.collect_set(F.when(F.col("kind") == "category", F.col("value"))).alias("ignored_categories"),
        )
        .select(
            "repo", _merge_runs(F.col("paths")).alias("path_runs"),
            S.nonempty("rule_regex").alias("rule_regex"), "ignored_categories",
        )
    )


def suppression_reason(file: str = "file", rule_id: str = "rule_id", category: str = "category") -> Column:
    """'category', 'rule' or 'path' for a row joined with its compiled list, else null."""
    by_category = F.array_contains("ignored_categories", F.lower(category))
    by_rule = F.rlike(F.col(rule_id), F.col("rule_regex")) & (F.col(rule_id) != "")
    by_path = F.aggregate(
        "path_runs",
        F.lit(False),
        lambda hit, run: F.when(F.rlike(F.col(file), run["regex"]), ~run["negated"]).otherwise(hit),
    ) & (F.col(file) != "")
    return (
        F.when(F.coalesce(by_category, F.lit(False)), F.lit("category"))
        .when(F.coalesce(by_rule, F.lit(False)), F.lit("rule"))
        .when(F.coalesce(by_path, F.lit(False)), F.lit("path"))
    )


def mark_suppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Add ``suppressed_by``; kept rows have null. The hot repository's rows are salted, where they lie if they are laid out by ``TASK``."""
    lists = compile_suppressions(suppressions)
    if TASK in findings.columns:
        joined = findings.join(for_all_spreads(lists), [TASK, "repo", SPREAD], "left")
    else:
        joined = salted_join(findings, lists, ["repo"], ["file", "rule_id", "line", "message"])
    return joined.withColumn("suppressed_by", suppression_reason()).drop(
        "path_runs", "rule_regex", "ignored_categories"
    )
