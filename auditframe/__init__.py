"""Security findings across many repositories, as Spark DataFrames.

The names below are the library; everything takes and returns DataFrames.
"""

from auditframe.functions.scalars import (
    dedup_key,
    fingerprint,
    infer_category,
    meets_threshold,
    normalize_path,
    normalize_severity,
    redact,
)
from auditframe.operators.dedup import build_baseline, dedup, known_findings, mark_known, new_findings
from auditframe.operators.findings import FINDING, concat_findings, make_findings
from auditframe.operators.inline import drop_inline_suppressed, mark_inline
from auditframe.operators.profile import node_constraint, repo_markers, repo_profile
from auditframe.operators.routes import check_findings
from auditframe.operators.rules import rule_findings, secret_findings
from auditframe.operators.summary import gate, select_analyzers, sort_findings, summarize, top_findings
from auditframe.operators.suppress import mark_suppressed, parse_ignore_lines
from auditframe.operators.taint import reach, taint_findings
from auditframe.plans.reports import FORMATS, render_report, write_lines
from auditframe.plans.scan import drop_counters, issues, reported, verdicts, write_baseline, write_findings
from auditframe.session import build_session
from auditframe.sources.config import overlay_config, read_baseline, unknown_keys
from auditframe.sources.files import json_lines, lines, list_files
from auditframe.sources.reports import READERS, analyzer_status, read_reports, report_status
from auditframe.streaming.jobs import drop_repeats, findings_from, windowed_gate

__all__ = [
    "FINDING", "FORMATS", "READERS", "analyzer_status", "build_baseline", "build_session", "check_findings",
    "concat_findings", "dedup", "dedup_key", "drop_counters", "drop_inline_suppressed", "drop_repeats",
    "findings_from", "fingerprint", "gate", "infer_category", "issues", "json_lines", "known_findings", "lines",
    "list_files", "make_findings", "mark_inline", "mark_known", "mark_suppressed", "meets_threshold", "new_findings",
    "node_constraint", "normalize_path", "normalize_severity", "overlay_config", "parse_ignore_lines", "reach",
    "read_baseline", "read_reports", "redact", "render_report", "repo_markers", "repo_profile", "report_status",
    "reported", "rule_findings", "secret_findings", "select_analyzers", "sort_findings", "summarize",
    "taint_findings", "top_findings", "unknown_keys", "verdicts", "windowed_gate", "write_baseline",
    "write_findings", "write_lines",
]
