"""Registration of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditframe.queries import inputs as IN

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

# Check-side normalisation of the raw findings. Spellings of severities.
_NORM = r"""
SELECT repo_key, seq, repo, tool, rule_id,
 CASE WHEN lower(trim(severity_raw)) IN ('critical','crit') THEN 'critical'
  WHEN lower(trim(severity_raw)) IN ('high','error','severe') THEN 'high'
  WHEN lower(trim(severity_raw)) IN ('moderate','medium','warning','warn','med') THEN 'medium'
  WHEN lower(trim(severity_raw)) IN ('low','info','informational','note','unknown','negligible') THEN 'low'
  ELSE 'medium' END AS severity,
 CASE WHEN category_raw IN ('injection','secrets','dependency-cve','insecure-jwt','cors-misconfig') THEN category_raw ELSE 'other' END AS category,
 regexp_replace(replace(file_raw, '\', '/'), '^\./', '') AS file,
 CASE WHEN try_cast(line_raw AS DOUBLE) > 0 THEN CAST(floor(try_cast(line_raw AS DOUBLE)) AS INTEGER) END AS line,
 trim(message_raw) AS message,
 CASE WHEN lower(confidence_raw) IN ('high','medium','low') THEN lower(confidence_raw) ELSE 'high' END AS confidence,
 ai_relevant
FROM findings_raw
"""
_SEV = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_CONF = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
# Folders of other people's code.
_VENDORED = (
    "(list_has_any(string_split(file, '/'), ['node_modules','.venv','venv','vendor','site-packages',"
    "'bower_components','__pycache__','.git','.cache','.auditframe-cache','.pytest_cache','.mypy_cache','.tox',"
    "'.next','.nuxt','.svelte-kit','.gradle','.terraform','.serverless','.nyc_output']))"
)
# Check-side merge: representative by rank, ties by tool, rule, message.
_DEDUP = """
SELECT repo, file, line, category, tool, rule_id, message, confidence, ai_relevant,
 CASE top WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, n, agreed
FROM (SELECT *, row_number() OVER (PARTITION BY repo, file, line, category, CASE WHEN line IS NULL THEN rule_id END
   ORDER BY {conf} * 10 + {sev} DESC, tool, rule_id, message, ai_relevant) AS rn,
  max({sev}) OVER w AS top, count(*) OVER w AS n,
  CASE WHEN count(*) OVER w > 1 THEN array_to_string(list_sort(list_distinct(list(tool) OVER w)), ',') END AS agreed
 FROM {src}
 WINDOW w AS (PARTITION BY repo, file, line, category, CASE WHEN line IS NULL THEN rule_id END)) AS x WHERE rn = 1
"""
_BLOCKS = {
    "norm": (_NORM, ["findings_raw"]),
    "merged": (_DEDUP.format(src="norm", sev=_SEV, conf=_CONF), ["norm"]),
}


def sev(alias: str = "") -> str:
    return _SEV.replace("severity", alias + "severity")


def conf(alias: str = "") -> str:
    return _CONF.replace("confidence", alias + "confidence")


def vendored(column: str = "file") -> str:
    return _VENDORED.replace("(file,", f"({column},")


def dedup_of(source: str) -> str:
    return _DEDUP.format(src=source, sev=_SEV, conf=_CONF)


def with_inputs(names: list[str], body: str, recursive: bool = False) -> str:
    """Prefix a checking query with the inputs it names (and what those need)."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in parts:
            return
        if name in _BLOCKS:
            text, needs = _BLOCKS[name]
            for need in needs:
                add(need)
            parts[name] = text
        else:
            parts[name] = IN.checking_sql(name)

    for name in names:
        add(name)
    head = ",\n".join(f"{n} AS ({t})" for n, t in parts.items())
    if body.lstrip().upper().startswith("WITH "):
        body = ", " + body.lstrip()[5:]
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body}"


def query(check: str | None = None, uses: list[str] | None = None, recursive: bool = False, name: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if check is not None:
            CHECKS[key] = with_inputs(uses, check, recursive) if uses else check
        return fn

    return register
