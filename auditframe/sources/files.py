"""Source trees as tables: ``source_files(repo, path, content, n_bytes)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.sources.scanner import scanned

LINE_BREAK = r"\r?\n"


def listed(
    path: str | Column = "path",
    *,
    extensions: list[str] | None = None,
    ignored_dirs: list[str] | None = None,
    max_depth: int | None = None,
    name_pattern: str | None = None,
) -> Column:
    """Predicate: the file would be listed by a tree walk with these options."""
    # Only folders count here: a name is followed by a separator.
    names = V.UNLISTED_DIRS + list(ignored_dirs or [])
    keep = ~S.col_of(path).rlike(rf"(?:^|[/\\])(?:{S.any_literal(names)})[/\\]")
    if extensions is not None:
        keep = keep & S.extension(path).isin([e.lower() for e in extensions])
    if max_depth is not None:
        keep = keep & (F.size(S.segments(path)) - 1 <= max_depth)
    if name_pattern is not None:
        keep = keep & S.basename(path).rlike(name_pattern)
    return keep


def list_files(
    files: DataFrame, *, max_bytes: int | None = None, max_files: int | None = None, **options
) -> DataFrame:
    """Keep listed files; ``max_bytes`` skips larger files, ``max_files`` is a per-repo listing cap.

    No cap applies unless it is asked for. With one, the first paths in binary
    order stay; the ranking is cut per task before rows are exchanged.
    """
    out = files.filter(listed(**options))
    if max_bytes is not None:
        out = out.filter(F.col("n_bytes") <= max_bytes)
    if max_files is not None:
        order = W.partitionBy("repo").orderBy("path")
        out = out.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= max_files).drop("__rank")
    return out


def outside_dirs(path: str | Column, names: list[str]) -> Column:
    """Predicate for scanners that are told to leave directories out (bandit, eslint)."""
    return ~S.has_segment(path, names)


def bandit_target(path: str | Column = "path") -> Column:
    return outside_dirs(path, V.BANDIT_EXCLUDED_DIRS) & (S.extension(path) == ".py")


def eslint_target(path: str | Column = "path") -> Column:
    """JS/TS files outside build output, minified files excepted."""
    exts = V.JS_EXTENSIONS + [".mts", ".cts"]
    minified = F.endswith(S.basename(path), F.lit(".min.js"))
    return outside_dirs(path, V.ESLINT_EXCLUDED_DIRS) & S.extension(path).isin(exts) & ~minified


def lines(files: DataFrame, keys: list[str] | None = None, text: str = "content") -> DataFrame:
    """One row per line, numbered from 1; trailing empty lines are kept."""
    keys = keys or ["repo", "path"]
    split = F.posexplode(F.split(F.col(text), LINE_BREAK, -1))
    return files.select(*keys, split.alias("pos", "text")).select(
        *keys, (F.col("pos") + 1).alias("line"), "text"
    )


def statement_lines(files: DataFrame, language: str, keys: list[str] | None = None, text: str = "content") -> DataFrame:
    """One row per statement of files in one language; the number is that of its first line, comments are gone."""
    keys = keys or ["repo", "path"]
    found = files.select(*keys, scanned(F.col(text), language)["statements"].alias("statements"))
    # From the inner form the optimiser derives a filter that would scan every text a second time.
    return found.select(*keys, F.inline_outer("statements")).filter(F.col("line").isNotNull())


def json_lines(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """One row per valid JSON line of a JSONL payload; blank and broken lines are skipped."""
    numbered = lines(df, keys, payload)
    record = S.strip("text")
    return (
        numbered.select(*keys, "line", record.alias("record"))
        .filter(F.col("record") != "")
        .filter(F.try_parse_json("record").isNotNull())
    )
