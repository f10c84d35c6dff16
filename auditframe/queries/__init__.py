"""Registered queries over the given tables."""

from auditframe.queries import finding_queries, report_queries, source_queries, text_queries  # noqa: F401
from auditframe.queries.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
