"""The gate on a stream of reports. Transformations are the batch ones.

State is keyed and expires with the watermark, results go to files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.session import durable
from auditframe.sources.reports import read_reports


def findings_from(report_stream: DataFrame, tools: list[str] | None = None) -> DataFrame:
    """Findings of a report stream; stateless."""
    return read_reports(report_stream, tools)


def drop_repeats(findings: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First report of an issue per repository, as long as the watermark remembers it."""
    keyed = findings.withColumn("issue", S.dedup_key())
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["repo", "issue"])


def windowed_gate(
    findings: DataFrame,
    baseline: DataFrame | None = None,
    *,
    fail_on: str = "critical",
    time: str = "ts",
    window: str = "1 hour",
    delay: str = "1 hour",
) -> DataFrame:
    """(window_start, repo, new_findings, failed) per window and repository.

    Findings of a static baseline do not count. A window is emitted once the
    watermark has passed its end, then its state is dropped.
    """
    rows = findings.withColumn("fingerprint", S.fingerprint())
    if baseline is not None:
        rows = rows.join(baseline.select("repo", "fingerprint"), ["repo", "fingerprint"], "left_anti")
    reached = S.meets_threshold("severity", fail_on)
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.window(time, window), "repo")
        .agg(F.count("*").alias("new_findings"), F.bool_or(reached).alias("failed"))
        .select(F.col("window.start").alias("window_start"), "repo", "new_findings", "failed")
    )


_ESCALATED = "repo string, issue string, severity string, rule_id string, tool string, message string, raised boolean"


def escalations(findings: DataFrame, time: str = "ts", delay: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """(repo, issue, severity, rule_id, tool, message, raised): an issue when it is first seen, and again whenever it gets worse.

    State per issue is its best candidate so far (confidence, then severity, then the text of tool, rule and message, as in a batch)
    and the highest severity; it goes ``keep`` after the issue was last seen, by event time. Rows of an issue are read as
    a stream of batches, so one that holds a third of all rows needs no more memory than any other. Only the last row
    of an issue is its standing; ``raised`` tells the later ones.
    """
    keep_ms = _milliseconds(keep)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else None
        top, best, seen = (known[0], list(known[1:5]), known[5]) if known else (0, None, 0)
        was = top
        for batch in batches:
            seen = max(seen, int(batch["__ms"].max()))
            top = max(top, int(batch["__severity"].max()))
            first = batch.sort_values(["__rank", "tool", "rule_id", "message"], ascending=[False, True, True, True]).iloc[0]
            mine = [int(-first["__rank"]), first["tool"], first["rule_id"], first["message"]]
            best = mine if best is None or mine < best else best
        state.update((top, *best, seen))
        state.setTimeoutTimestamp(max(seen + keep_ms, state.getCurrentWatermarkMs() + 1))
        if top > was:
            yield pd.DataFrame(
                [(*key, V.SEVERITIES[top - 1], best[2], best[1], best[3], known is not None)],
                columns=["repo", "issue", "severity", "rule_id", "tool", "message", "raised"],
            )

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = findings.select(
        "repo", S.dedup_key().alias("issue"), time, text("tool"), text("rule_id"), text("message"),
        S.severity_ord("severity").alias("__severity"),
        (S.confidence_ord("confidence") * 10 + S.severity_ord("severity")).alias("__rank"),
        F.unix_millis(time).alias("__ms"),
    )
    return (
        rows.withWatermark(time, delay)
        .groupBy("repo", "issue")
        .applyInPandasWithState(
            run, _ESCALATED, "top int, rank int, tool string, rule_id string, message string, seen long", "append", "EventTimeTimeout"
        )
    )


def _milliseconds(span: str) -> int:
    number, unit = span.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def feed_baseline(
    findings: DataFrame, path: str, checkpoint: str, *, fail_on: str = "critical", **trigger
) -> StreamingQuery:
    """Keep a baseline beside a stream: every batch adds the findings that no batch before it had.

    ``path`` is a table (batch, repo, fingerprint, severity, reached). A batch reads only earlier batches and replaces
    its own folder, so one that is replayed after a failure changes nothing. What a batch adds is what a gate judges:
    see ``batch_gates``.
    """
    schema = "repo string, fingerprint string, severity string, reached boolean, batch long"
    spark = findings.sparkSession

    def add(rows: DataFrame, batch: int) -> None:
        reached = S.meets_threshold("severity", fail_on)
        found = rows.select("repo", S.fingerprint().alias("fingerprint"), "severity", S.severity_ord("severity").alias("o"), reached.alias("reached"))
        once = found.groupBy("repo", "fingerprint").agg(F.max(F.struct("o", "severity", "reached")).alias("w"))
        fresh = once.select("repo", "fingerprint", "w.severity", "w.reached")
        if batch:
            earlier = [f"{path}/batch={b}" for b in range(batch)]
            known = rows.sparkSession.read.schema(schema).option("basePath", path).parquet(*earlier)
            fresh = fresh.join(known.select("repo", "fingerprint"), ["repo", "fingerprint"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = findings.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def batch_gates(baseline: DataFrame) -> DataFrame:
    """(batch, repo, new_findings, failed) of a baseline that ``feed_baseline`` wrote."""
    return baseline.groupBy("batch", "repo").agg(F.count("*").alias("new_findings"), F.bool_or("reached").alias("failed"))


def reports_to_files(reports: DataFrame, path: str, checkpoint: str, tools: list[str] | None = None, **trigger) -> StreamingQuery:
    """Scanner reports of any tools through the batch readers, as findings below ``path``/batch=n.

    The stream has one source however many readers there are: a batch is stored once and read by each of them. A replayed
    batch replaces its own folder.
    """

    def run(rows: DataFrame, batch: int) -> None:
        held = durable(rows)
        read_reports(held, tools).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = reports.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; exactly once into Parquet."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
