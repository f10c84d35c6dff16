"""Column expressions: coercions, name mappings, text helpers.

Every function takes and returns Spark columns, so all of it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe import vocabulary as V

# All white space a report may carry around a value, not only ASCII blanks.
_SPACE = (
    " \t\n\r\u000b\u000c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
_POSITIVE = r"^\s*\+?(?=[\d.]*[1-9])(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def col_of(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(key, mapping: Mapping[str, object], default: object = None) -> Column:
    """Value of a small fixed mapping. The key is evaluated once, unlike in a CASE."""
    pairs = [F.lit(x) if not isinstance(x, Column) else x for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), col_of(key))
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def nonempty(c) -> Column:
    """Null for empty text."""
    c = col_of(c)
    return F.when(c != "", c)


def first_nonempty(*cols) -> Column:
    return F.coalesce(*[nonempty(c) for c in cols])


def strip(c) -> Column:
    """Trim every kind of white space (``trim`` removes blanks only)."""
    return F.btrim(col_of(c), F.lit(_SPACE))


def starts_with_any(c: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def contains_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


# --- paths -----------------------------------------------------------------


def normalize_path(c) -> Column:
    posix = F.replace(col_of(c), F.lit("\\"), F.lit("/"))
    return F.coalesce(F.regexp_replace(posix, r"^\./", ""), F.lit(""))


def segments(path) -> Column:
    return F.split(F.replace(col_of(path), F.lit("\\"), F.lit("/")), "/", -1)


def basename(path) -> Column:
    return F.substring_index(F.replace(col_of(path), F.lit("\\"), F.lit("/")), "/", -1)


def dirname(path) -> Column:
    """Directory part of a path, ``.`` for top-level files."""
    path = col_of(path)
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def extension(path) -> Column:
    """Lower-cased extension of the file name; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(col_of(path), r"[^/\\](\.[^./\\]*)$", 1))


def any_literal(words: Iterable[str]) -> str:
    """Alternation of words taken literally."""
    special = "\\^$.|?*+()[]{}"
    return "|".join("".join("\\" + c if c in special else c for c in w) for w in words)


def has_segment(path, names: list[str]) -> Column:
    """Some segment of the path, the file name included, is one of the names."""
    return col_of(path).rlike(rf"(?:^|[/\\])(?:{any_literal(names)})(?:[/\\]|$)")


def is_vendored(path) -> Column:
    return F.coalesce(has_segment(path, V.VENDORED_DIRS), F.lit(False))


_DATA_FILE = rf"[^/\\](?:{any_literal(V.DATA_EXTENSIONS)})$"
_TEST_FILE = rf"(?:^|[/\\])(?:{any_literal(V.TEST_DIRS)})(?:[/\\]|$)|{V.TEST_FILE_PATTERN}"


def is_data_file(path) -> Column:
    return F.coalesce(F.lower(col_of(path)).rlike(_DATA_FILE), F.lit(False))


def is_test_file(path) -> Column:
    return F.coalesce(F.lower(col_of(path)).rlike(_TEST_FILE), F.lit(False))


def resolve_path(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments from a posix path."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/", -1),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s.isin("", "."), acc)
            .when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, s)),
        ),
        "/",
    )


def import_candidates(source, from_path) -> Column:
    """Files a relative import may mean, best first; null for package imports."""
    source = col_of(source)
    joined = resolve_path(F.concat(dirname(from_path), F.lit("/"), source))
    options = [joined]
    options += [F.concat(joined, F.lit(e)) for e in V.JS_EXTENSIONS]
    options += [F.concat(joined, F.lit("/index" + e)) for e in V.JS_EXTENSIONS]
    return F.when(source.startswith("."), F.array(*options))


# --- numbers ---------------------------------------------------------------


def coerce_line(c) -> Column:
    """Positive number in decimal or exponent notation, rounded down; anything else is null."""
    text = F.regexp_extract(col_of(c).cast("string"), _POSITIVE, 0)
    return F.floor(text.try_cast("double")).try_cast("int")


def coerce_column(c) -> Column:
    """Number from 0 up, rounded down; blank text is 0."""
    text = col_of(c).cast("string")
    number = F.regexp_extract(text, _NUMBER, 0).try_cast("double")
    number = F.coalesce(number, F.when(strip(text) == "", F.lit(0.0)))
    return F.when(~text.contains("-") | (number >= 0), F.floor(number).try_cast("int"))


# --- enumerations ----------------------------------------------------------


_SEVERITY_OF = {word: name for name, words in V.SEVERITY_ALIASES.items() for word in words}


def _same(words: Iterable[str]) -> dict[str, str]:
    return {w: w for w in words}


def coerce_severity(c) -> Column:
    return lookup(F.lower(col_of(c)), _same(V.SEVERITIES), "medium")


def coerce_confidence(c) -> Column:
    return lookup(F.lower(col_of(c)), _same(V.CONFIDENCES), "high")


def coerce_category(c) -> Column:
    return lookup(c, _same(V.CATEGORIES), "other")


def coerce_message(c) -> Column:
    return F.coalesce(nonempty(strip(c)), F.lit(V.EMPTY_MESSAGE))


def normalize_severity(c, fallback: str | Column = "medium") -> Column:
    """Scanner spelling to the four-level scale; the fallback covers null and unknown words."""
    return lookup(F.lower(strip(c)), _SEVERITY_OF, fallback)


def map_confidence(c, fallback: str) -> Column:
    return lookup(F.lower(col_of(c)), _same(V.CONFIDENCES), fallback)


def severity_ord(c) -> Column:
    return lookup(c, V.SEVERITY_ORD, 0)


def severity_name(ord_col) -> Column:
    return lookup(ord_col, {n: name for name, n in V.SEVERITY_ORD.items()})


def confidence_ord(c) -> Column:
    return lookup(c, V.CONFIDENCE_ORD, 0)


def meets_threshold(severity, threshold: str) -> Column:
    """False for every severity when the threshold itself is unknown; its case does not matter."""
    level = V.SEVERITY_ORD.get(threshold.lower())
    return F.lit(False) if level is None else severity_ord(severity) >= level


def infer_category(lowered, fallback: str = "other") -> Column:
    """First category whose pattern occurs in the text.

    The text must be lower-cased already, in a column of its own, so that it is
    computed once and not once per pattern.
    """
    lowered = col_of(lowered)
    out = None
    for pattern, category in V.CATEGORY_PATTERNS:
        cond = lowered.rlike(pattern)
        out = F.when(cond, F.lit(category)) if out is None else out.when(cond, F.lit(category))
    return out.otherwise(F.lit(fallback))


def bandit_category(test_id) -> Column:
    return lookup(test_id, {i: category for category, ids in V.BANDIT_CATEGORIES.items() for i in ids})


def eslint_meta(rule_id) -> Column:
    """struct(category, severity, confidence) of an eslint rule."""

    def triple(values):
        names = ("category", "severity", "confidence")
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])

    table = {rule: triple(values) for rule, values in V.ESLINT_RULES.items()}
    return lookup(rule_id, table, triple(("other", "medium", "medium")))


def secret_severity(rule_id) -> Column:
    low = F.lower(F.coalesce(col_of(rule_id), F.lit("")))
    return F.when(low.rlike("private[-_]?key|rsa|pgp|-----begin"), F.lit("critical")).otherwise(F.lit("high"))


def sink_category(last_segment) -> Column:
    return F.when(col_of(last_segment).isin(V.FILE_SINKS), F.lit("path-traversal")).otherwise(F.lit("injection"))


def last_segment(dotted) -> Column:
    return F.substring_index(col_of(dotted), ".", -1)


# --- texts -----------------------------------------------------------------


def redact(c) -> Column:
    """Hide a secret: three characters and the length are all that stays."""
    c = F.coalesce(col_of(c).cast("string"), F.lit(""))
    n = F.length(c)
    return (
        F.when(n == 0, F.lit("[redacted]"))
        .when(n <= 6, F.lit("******"))
        .otherwise(F.concat(F.left(c, F.lit(3)), F.lit("…[redacted, "), n.cast("string"), F.lit(" chars]")))
    )


def ghsa_id(url) -> Column:
    return nonempty(F.regexp_extract(F.coalesce(col_of(url), F.lit("")), r"(?i)GHSA-[0-9a-z-]+", 0))


def advisory_links(advisory_id, aliases) -> Column:
    """Links for CVE, PYSEC, GHSA and OSV ids, other ids are left out."""
    ids = F.concat(F.array(col_of(advisory_id)), F.coalesce(col_of(aliases), F.array().cast("array<string>")))
    links = F.transform(
        ids,
        lambda i: F.when(i.rlike("(?i)^CVE-"), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), i)).when(
            i.rlike("(?i)^(PYSEC|GHSA|OSV)-"), F.concat(F.lit("https://osv.dev/vulnerability/"), i)
        ),
    )
    return F.array_compact(links)


def npm_fix_text(fix, package) -> Column:
    """Advice from npm's ``fixAvailable``, which is a boolean or an object (here: JSON text)."""
    fix, package = col_of(fix), col_of(package)
    target = F.from_json(fix, "name string, version string, isSemVerMajor boolean")
    return (
        F.when(fix == "true", F.concat(F.lit("An update fixes this; review it with npm audit and raise "), package, F.lit(".")))
        .when(
            fix.startswith("{"),
            F.concat(
                F.lit("Update to "), target["name"], F.lit("@"), target["version"],
                F.when(target["isSemVerMajor"], F.lit(" (major release)")).otherwise(F.lit("")), F.lit("."),
            ),
        )
        .otherwise(F.lit("No automatic update exists; read the advisory and look for a patched or other package."))
    )


def markdown_escape(c) -> Column:
    c = F.coalesce(col_of(c).cast("string"), F.lit(""))
    return strip(F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\r?\n", " "))


def markdown_code(c) -> Column:
    c = F.coalesce(col_of(c).cast("string"), F.lit(""))
    return F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("")), F.lit("`"))


# --- keys ------------------------------------------------------------------


def fingerprint(tool="tool", rule_id="rule_id", category="category", file="file", message="message") -> Column:
    """Line-independent identity of an issue: survives edits that only move it."""
    parts = [F.coalesce(col_of(c), F.lit("")) for c in (tool, rule_id, category, file)]
    parts.append(strip(F.coalesce(col_of(message), F.lit(""))))
    return F.sha1(F.concat_ws("\u0000", *parts).cast("binary"))


def dedup_key(file="file", line="line", category="category", rule_id="rule_id") -> Column:
    """Text form of the key under which findings of several tools are one issue."""
    file = F.coalesce(nonempty(file), F.lit("?"))
    line, category = col_of(line), col_of(category)
    return F.when(
        line.isNotNull(), F.concat_ws("::", file, line.cast("string"), category)
    ).otherwise(F.concat_ws("::", file, F.lit("*"), category, F.coalesce(nonempty(rule_id), F.lit("?"))))


# --- globs -----------------------------------------------------------------


def _escape(c: Column, chars: str) -> Column:
    for ch in chars:
        c = F.replace(c, F.lit(ch), F.lit("\\" + ch))
    return c


def path_glob_regex(pattern) -> Column:
    """Ignore-file path pattern (without its ``!``) to a regular expression."""
    raw = col_of(pattern)
    anchored = raw.startswith("/")
    body = F.when(anchored, F.substr(raw, F.lit(2))).otherwise(raw)
    body = F.when(body.endswith("/"), F.left(body, F.length(body) - 1)).otherwise(body)
    nested = body.contains("/")
    out = _escape(body, "\\^$.|+()[]{}")
    for found, put in [
        ("**/", "\u0001"), ("**", "\u0001"), ("*", "[^/]*"), ("?", "[^/]"), ("\u0001", ".*"),
    ]:
        out = F.replace(out, F.lit(found), F.lit(put))
    prefix = F.when(anchored | nested, F.lit("^")).otherwise(F.lit("(^|/)"))
    return F.concat(prefix, out, F.lit("(/.*)?$"))


def rule_glob_regex(pattern) -> Column:
    """Rule pattern with ``*`` to a case-insensitive regular expression for the whole id."""
    body = F.replace(_escape(col_of(pattern), "\\^$.|+()[]{}?"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("(?i)^"), body, F.lit("$"))
