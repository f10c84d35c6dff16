"""Line rules, the handler rule, secret detection and rule evaluation over source text.

Rule patterns are literals, so each is compiled once; a cheap substring test
runs before every pattern and, for whole files, before the text is scanned at
all. Statements come from the scanner, so comments take no part and calls may
span lines. No step shuffles.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.operators.findings import make_findings
from auditframe.session import durable
from auditframe.sources.files import lines, statement_lines
from auditframe.sources.scanner import scanned


class Rule(NamedTuple):
    name: str
    language: str
    severity: str
    category: str
    confidence: str
    needles: list[str]
    pattern: str

    @property
    def rule_id(self) -> str:
        return V.RULE_PREFIX + self.name


# Rule names, levels, categories and line patterns. The needles
# are substrings without which the pattern cannot match.
LINE_RULES = [
    Rule("insecure-cookie-httponly-false", "js", "medium", "insecure-cookie-flags", "high", ["httpOnly"],
         r"\.cookie\([^)]*\bhttpOnly\s*:\s*false\b|\bsession\(.*\bcookie\s*:\s*\{[^}]*\bhttpOnly\s*:\s*false\b"),
    Rule("insecure-cookie-secure-false", "js", "medium", "insecure-cookie-flags", "medium", ["secure"],
         r"\.cookie\([^)]*\bsecure\s*:\s*false\b|\bsession\(.*\bcookie\s*:\s*\{[^}]*\bsecure\s*:\s*false\b"),
    Rule("insecure-cookie-flask", "py", "medium", "insecure-cookie-flags", "high", ["set_cookie(", "SESSION_COOKIE_"],
         r"""\.set_cookie\(.*\b(?:httponly|secure)\s*=\s*False\b|\.config\[['"]SESSION_COOKIE_(?:HTTPONLY|SECURE)['"]\]\s*=\s*False\b"""),
    Rule("cors-wildcard-origin", "js", "medium", "cors-misconfig", "high", ["Access-Control-Allow-Origin", "cors("],
         r"""\.(?:header|set|setHeader)\(\s*['"]Access-Control-Allow-Origin['"]\s*,\s*['"]\*['"]\s*\)|\bcors\(\{.*\borigin\s*:\s*(?:['"]\*['"]|true\b)"""),
    Rule("cors-wildcard-origin-python", "py", "medium", "cors-misconfig", "medium", ["CORS(", "Access-Control-Allow-Origin"],
         r"""\bCORS\(\s*\w+\s*(?:,\s*origins\s*=\s*['"]\*['"]\s*)?\)|\.headers\[['"]Access-Control-Allow-Origin['"]\]\s*=\s*['"]\*['"]"""),
    Rule("flask-debug-true", "py", "high", "insecure-config", "high", ["debug"],
         r"\.run\(.*\bdebug\s*=\s*True\b|\b\w+\.debug\s*=\s*True\b"),
    Rule("django-debug-true", "py", "medium", "insecure-config", "medium", ["DEBUG"],
         r"^\s*DEBUG\s*=\s*True\b"),
    Rule("error-stack-to-client-js", "js", "medium", "info-disclosure", "medium", [".stack"],
         r"\.send\(\s*\w+\.stack\s*\)|\.json\(\{.*:\s*\w+\.stack\b"),
    Rule("traceback-to-client-python", "py", "medium", "info-disclosure", "medium", ["traceback.format_exc("],
         r"\breturn\s+(?:[^,]+,\s*)?traceback\.format_exc\(\)"),
    Rule("graphql-introspection-enabled", "js", "medium", "insecure-config", "medium", ["introspection"],
         r"\bnew\s+(?:ApolloServer\(\{.*\bintrospection\s*:\s*true\b|\w+\(\{.*\bintrospection\s*:\s*true\b.*\bplayground\s*:\s*true\b)"),
    Rule("hallucinated-security-api-js", "js", "medium", "other", "low", ["jwt.validate(", "bcrypt.", "crypto."],
         r"\b(?:jwt\.validate|bcrypt\.(?:verify|encrypt|decrypt)|crypto\.(?:encrypt|decrypt))\("),
    Rule("hallucinated-security-api-python", "py", "medium", "other", "low", ["jwt.validate(", "bcrypt.", "hashlib.encrypt("],
         r"\b(?:jwt\.validate|bcrypt\.(?:verify|encrypt)|hashlib\.encrypt)\("),
    Rule("jwt-algorithm-none", "js", "high", "insecure-jwt", "high", ["jwt."],
         r"""\bjwt\.(?:verify\(.*\balgorithms\s*:\s*\[\s*['"][Nn]one['"]\s*\]|sign\(.*\balgorithm\s*:\s*['"]none['"])"""),
    Rule("jwt-hardcoded-secret", "js", "high", "insecure-jwt", "high", ["jwt."],
         r"""\bjwt\.(?:sign|verify)\([^,]+,\s*(?:"[^"]*"|'[^']*')"""),
    Rule("jwt-missing-expiration", "js", "medium", "insecure-jwt", "medium", ["jwt.sign("],
         r"""\bjwt\.sign\(\s*[^,()]+,\s*[^,()'"]+\)"""),
    Rule("jwt-verify-disabled-python", "py", "high", "insecure-jwt", "high", ["jwt.decode("],
         r"""\bjwt\.decode\(.*(?:\bverify\s*=\s*False\b|['"]verify_signature['"]\s*:\s*False\b)"""),
    Rule("jwt-algorithm-none-python", "py", "high", "insecure-jwt", "high", ["jwt.decode("],
         r"""\bjwt\.decode\(.*\balgorithms\s*=\s*\[\s*['"]none['"]\s*\]"""),
    Rule("tls-reject-unauthorized-false", "js", "high", "insecure-transport", "high", ["rejectUnauthorized"],
         r"\brejectUnauthorized\s*:\s*false\b"),
    Rule("node-tls-reject-env", "js", "high", "insecure-transport", "high", ["NODE_TLS_REJECT_UNAUTHORIZED"],
         r"""process\.env\.NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]0['"]"""),
    Rule("requests-verify-false", "py", "high", "insecure-transport", "high", ["requests."],
         r"\brequests\.\w+\(.*\bverify\s*=\s*False\b"),
    Rule("ssl-unverified-context", "py", "high", "insecure-transport", "high", ["ssl._create_unverified_context("],
         r"\bssl\._create_unverified_context\("),
    Rule("weak-password-hash-js", "js", "high", "insecure-crypto", "medium", ["crypto.createHash("],
         r"""crypto\.createHash\(\s*['"](?:md5|sha1|sha256)['"]\s*\)\.update\([^)]*(?i:pass|pwd|secret|credential)[^)]*\)"""),
    Rule("weak-password-hash-python", "py", "high", "insecure-crypto", "medium", ["hashlib."],
         r"\bhashlib\.(?:md5|sha1|sha256)\([^)]*(?i:pass|pwd|secret|credential)[^)]*\)"),
]
# A function or arrow given to a call, as the scanner shows arguments: without what stands in their own brackets.
HANDLER = r"^(?:async\s*)?(?:function\s*\(\)|\(\)\s*=>)\s*\{\}$"
HANDLER_RULE = Rule("webhook-missing-signature", "js", "medium", "missing-auth", "low", [".post("], HANDLER)
HANDLER_PATH = r"(?i)(webhook|/hook|stripe|github|payment|callback)"
HANDLER_CHECKED = r"(?i)(signature|verif|hmac|createhmac|x-hub|stripe-signature|timingsafeequal|constant_?time)"
RULES = [*LINE_RULES, HANDLER_RULE]
LANGUAGE_EXTENSIONS = {"js": V.JS_EXTENSIONS, "py": V.PY_EXTENSIONS}


def rules_table(spark: SparkSession) -> DataFrame:
    """The rule catalogue as a table."""
    rows = [(r.rule_id, r.language, r.severity, r.category, r.confidence, r.pattern) for r in RULES]
    return spark.createDataFrame(
        rows, "rule_id string, language string, severity string, category string, confidence string, pattern string"
    )


def language_of(path: str | Column = "path") -> Column:
    ext = S.extension(path)
    out = None
    for language, exts in LANGUAGE_EXTENSIONS.items():
        cond = ext.isin(exts)
        out = F.when(cond, F.lit(language)) if out is None else out.when(cond, F.lit(language))
    return out


def _rule_struct(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.category).alias("category"),
        F.lit(rule.confidence).alias("confidence"),
    )


def _rule_hit(text: Column, rule: Rule) -> Column:
    found = S.contains_any(text, rule.needles) & text.rlike(rule.pattern)
    return found & _outside_strings(text, F.array(*[F.lit(n) for n in rule.needles]))


def _outside_strings(text: Column, needles: Column) -> Column:
    """Some needle is there; one that can only be code, such as the beginning of a call, not just in a string."""
    bare = F.regexp_replace(text, V.STRINGS, '""')
    return F.exists(needles, lambda n: F.contains(text, n) & (~n.rlike(r"[.(]") | F.contains(bare, n)))


def scan_rules(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(repo, path, line, rule_id, severity, category, confidence) per matching statement and rule.

    Only files that hold what a rule of their language looks for are scanned; comments take no part, and calls over
    several lines are one statement.
    """
    rules = rules or LINE_RULES
    out = None
    for language in sorted({r.language for r in rules}):
        mine = [r for r in rules if r.language == language]
        words = sorted({n for r in mine for n in r.needles})
        candidates = files.filter(language_of() == language).filter(S.contains_any(F.col("content"), words))
        text = F.col("text")
        rows = statement_lines(candidates, language).filter(S.contains_any(text, words))
        hits = F.array_compact(
            F.array(*[F.when(_rule_hit(text, r), _rule_struct(r)) for r in mine])
        )
        found = rows.select("repo", "path", "line", F.inline(hits))
        out = found if out is None else out.unionByName(found)
    return out


_WORD = "[A-Za-z0-9_$]+"


def whole_words(needle: str, pattern: str) -> list[str]:
    """Words that stand whole wherever the pattern finds the needle: those inside it, and those the pattern bounds itself."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9_$]+", needle)]
    bounded = lambda word: rf"\b{word}\b" in pattern or (rf"\b{word}" in pattern and not needle.endswith(word))
    return [w for a, b, w in words if (a > 0 and b < len(needle)) or bounded(w)]


def table_of_rules(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """Rules as rows: what ``scan_rule_table`` reads. ``needles`` are alternatives, each with its whole words in ``words``."""
    rows = [
        (r.rule_id, r.language, r.severity, r.category, r.confidence, r.pattern, r.needles, [whole_words(n, r.pattern) for n in r.needles])
        for r in rules or LINE_RULES
    ]
    return spark.createDataFrame(rows, _RULE_ROW)


_RULE_ROW = (
    "rule_id string, language string, severity string, category string, confidence string, pattern string,"
    " needles array<string>, words array<array<string>>"
)


#: Rules that one task numbers and lists, so that a long table is spread over tasks.
RULES_PER_PASS = 5_000
#: Tasks that statements are dealt to where an alternative of a rule has no whole word to be found by.
WORDLESS_SALTS = 16
_RULE_FIELDS = ["rule_id", "severity", "category", "confidence", "pattern", "needles"]


def _words_of(text: Column) -> Column:
    """Distinct words of a text; a dollar sign belongs to a word and bounds it, as patterns see it."""
    found = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    with_dollar = F.concat(found, F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    return F.array_distinct(F.when(text.contains("$"), with_dollar).otherwise(found))


def scan_rule_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits of the rules of a table (columns of ``table_of_rules``) of any length, as ``scan_rules`` gives them.

    Words of the rules make an inverted index: each alternative of a rule is listed under the rarest of its words, counted over
    the files. A statement's own words are joined with it, so what a statement costs grows with the rules that may match,
    not with the table. An alternative without a whole word is tried on every statement of its language. Files are read
    once to count and once to scan, however many rules there are.
    """
    dealt = rules.select("language", "words", *_RULE_FIELDS).repartition(max(1, -(-rules.count() // RULES_PER_PASS)))
    numbered = durable(dealt.withColumn("__n", F.monotonically_increasing_id()))
    asked = [r["language"] for r in numbered.select("language").filter(F.col("language").isin(list(LANGUAGE_EXTENSIONS))).distinct().collect()]
    if not asked:
        return files.limit(0).select("repo", "path", F.lit(0).alias("line"), F.inline(F.array(_rule_struct(LINE_RULES[0]))))
    index, wordless = _rule_index(files, numbered)
    text, rows = F.col("text"), None
    for language in sorted(asked):
        found = statement_lines(files.filter(language_of() == language), language).withColumn("language", F.lit(language))
        rows = found if rows is None else rows.unionByName(found)
    keys = _words_of(text)
    if wordless:
        salt = F.pmod(F.xxhash64("repo", "path", "line"), F.lit(WORDLESS_SALTS))
        keys = F.array_append(keys, F.concat(F.lit(" "), salt.cast("string")))
    tried = rows.select("*", F.explode(keys).alias("__key")).join(index, ["language", "__key"])
    # A rule is tried once a statement: by the first of its words that is there.
    first = (F.size("earlier") == 0) | ~F.arrays_overlap(_words_of(text), F.col("earlier"))
    found = F.exists("needles", lambda needle: F.contains(text, needle)) & F.rlike(text, F.col("pattern"))
    hit = found & first & _outside_strings(text, F.col("needles"))
    return tried.filter(hit).select("repo", "path", "line", *_RULE_FIELDS[:4])


def _rule_index(files: DataFrame, rules: DataFrame) -> tuple[DataFrame, bool]:
    """Rules by the keys they are listed under, with the keys of a rule before each, and whether any has no word.

    Rules without a word for some alternative stand under a blank and a number, once for each.
    """
    alternatives = rules.select("language", "__n", F.explode("words").alias("words")).withColumn("words", F.array_remove("words", ""))
    any_with = lambda cond: not alternatives.filter(cond).isEmpty()
    several, wordless = F.size("words") > 1, any_with(F.size("words") == 0)
    keyed = alternatives.filter(~several).select("__n", F.coalesce(F.get("words", F.lit(0)), F.lit(" ")).alias("key"))
    if any_with(several):  # with one word each there is nothing to choose
        choices = alternatives.filter(several).withColumn("__alternative", F.monotonically_increasing_id())
        choices = durable(choices.select("language", "__n", "__alternative", F.explode("words").alias("key")))
        known = files.select(language_of().alias("language"), "content").filter(F.col("language").isNotNull())
        own = known.select("language", F.explode(_words_of(F.col("content"))).alias("key"))
        common = own.join(choices.select("language", "key").distinct(), ["language", "key"], "left_semi").groupBy("language", "key").count()
        ranked = choices.join(common, ["language", "key"], "left").groupBy("__n", "__alternative")
        rarest = ranked.agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "key")).alias("rarest"))
        keyed = keyed.unionByName(rarest.select("__n", F.col("rarest.key").alias("key")))
    blanks = F.transform(F.sequence(F.lit(0), F.lit(WORDLESS_SALTS - 1)), lambda i: F.concat(F.lit(" "), i.cast("string")))
    listed_under = keyed.groupBy("__n").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    placed = rules.drop("words").join(listed_under, "__n").withColumn("blank", F.array_contains("keys", " "))
    placed = placed.select("*", F.posexplode(F.when(F.col("blank"), blanks).otherwise(F.col("keys"))).alias("at", "__key"))
    earlier = F.when(F.col("blank"), F.array().cast("array<string>")).otherwise(F.slice("keys", F.lit(1), F.col("at")))
    return placed.select("language", "__key", *_RULE_FIELDS, earlier.alias("earlier")), wordless


def scan_handlers(files: DataFrame) -> DataFrame:
    """Webhook handlers that never look at a signature; the line is where the call starts.

    A handler is the second and last argument of a ``post`` call, from its opening bracket to the matching one;
    one that is never closed is not judged.
    """
    js = files.filter(S.extension("path").isin(V.JS_EXTENSIONS)).filter(F.col("content").rlike(r"\.\s*post\s*\("))
    calls = scanned(F.col("content"), "js", ("post",), HANDLER_CHECKED)["calls"]
    # From the inner form the optimiser derives a filter that would scan every text a second time.
    found = js.select("repo", "path", calls.alias("calls")).select("repo", "path", F.inline_outer("calls")).filter(F.col("line").isNotNull())
    args = F.filter("args", lambda a: a != "")  # a comma may stand behind the last
    judged = found.withColumn("args", args).filter(
        (F.size("args") == 2)
        & F.col("args")[0].rlike(V.STRING_VALUE)
        & F.col("args")[0].rlike(HANDLER_PATH)
        & F.col("args")[1].rlike(HANDLER)
        & ~F.col("marked")
    )
    return judged.select("repo", "path", "line", F.inline(F.array(_rule_struct(HANDLER_RULE))))


def rule_findings(files: DataFrame) -> DataFrame:
    """Rule and handler hits as findings."""
    hits = scan_rules(files).unionByName(scan_handlers(files))
    return make_findings(
        hits,
        repo="repo",
        tool=F.lit("semgrep"),
        rule_id="rule_id",
        severity="severity",
        category="category",
        confidence="confidence",
        file="path",
        line="line",
        message=F.concat(F.lit("Insecure pattern: "), F.regexp_replace("rule_id", "^" + V.RULE_PREFIX, "")),
        ai_relevant=F.lit(True),
    )


# --- evaluation ------------------------------------------------------------


def rule_annotations(files: DataFrame) -> DataFrame:
    """``ruleid:`` and ``ok:`` comments, each about the next line: (repo, path, line, rule_id, expected)."""
    marked = files.filter(F.col("content").rlike(r"(//|#)\s*(ruleid|ok):"))
    note = r"(?://|#)\s*(ruleid|ok):\s*(.+)$"
    rows = lines(marked).filter(F.col("text").rlike(note))
    ids = F.filter(F.split(F.regexp_extract("text", note, 2), r"[,\s]+"), lambda x: x != "")
    return rows.select(
        "repo",
        "path",
        (F.col("line") + 1).alias("line"),
        F.explode(F.array_distinct(ids)).alias("rule_id"),
        (F.regexp_extract("text", note, 1) == "ruleid").alias("expected"),
    )


def evaluate_rules(annotations: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per annotation or hit with its outcome: TP, FN, FP, TN or unannotated."""
    on = ["repo", "path", "line", "rule_id"]
    actual = hits.select(*on).distinct().withColumn("__hit", F.lit(True))
    joined = annotations.join(actual, on, "full_outer")
    hit = F.coalesce("__hit", F.lit(False))
    outcome = (
        F.when(F.col("expected").isNull(), F.lit("unannotated"))
        .when(F.col("expected") & hit, F.lit("TP"))
        .when(F.col("expected"), F.lit("FN"))
        .when(hit, F.lit("FP"))
        .otherwise(F.lit("TN"))
    )
    return joined.select(*on, outcome.alias("outcome"))


def rule_totals(outcomes: DataFrame) -> DataFrame:
    """Counts per rule."""
    names = ["TP", "FN", "FP", "TN", "unannotated"]
    return outcomes.groupBy("rule_id").agg(
        *[F.count_if(F.col("outcome") == n).alias(n.lower()) for n in names]
    )


def check_catalogue(rules: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Problems in a rule table: duplicate ids, bad levels or categories, missing examples.

    ``rules(rule_id, severity, category)``, ``examples(rule_id, expected)``.
    Result: (rule_id, problem).
    """
    per_rule = rules.groupBy("rule_id").agg(
        F.count("*").alias("n"),
        F.bool_and(F.coalesce(F.col("severity").isin(V.SEVERITIES), F.lit(False))).alias("severity_ok"),
        F.bool_and(F.coalesce(F.col("category").isin(V.CATEGORIES), F.lit(False))).alias("category_ok"),
    )
    problems = [
        F.when(F.col("n") > 1, F.lit("duplicate id")),
        F.when(~F.col("severity_ok"), F.lit("invalid severity")),
        F.when(~F.col("category_ok"), F.lit("invalid category")),
    ]
    if examples is not None:
        shown = examples.groupBy("rule_id").agg(
            F.bool_or("expected").alias("positive"), F.bool_or(~F.col("expected")).alias("negative")
        )
        per_rule = per_rule.join(shown, "rule_id", "left")
        problems += [
            F.when(~F.coalesce("positive", F.lit(False)), F.lit("no positive example")),
            F.when(~F.coalesce("negative", F.lit(False)), F.lit("no negative example")),
        ]
    return per_rule.select("rule_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


# --- secrets ---------------------------------------------------------------


class SecretDetector(NamedTuple):
    name: str
    confidence: str
    needles: list[str]
    pattern: str  # group 1 is the secret


SECRET_DETECTORS = [
    SecretDetector("private-key", "high", ["PRIVATE KEY"], r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)"),
    SecretDetector("aws-access-key-id", "high", ["AKIA"], r"\b(AKIA[0-9A-Z]{16})\b"),
    SecretDetector("github-token", "high", ["gh"], r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b"),
    SecretDetector("slack-token", "high", ["xox"], r"\b(xox[abpr]-[A-Za-z0-9-]{10,})"),
    SecretDetector("stripe-live-key", "high", ["_live_"], r"\b([rs]k_live_[A-Za-z0-9]{16,})\b"),
    SecretDetector(
        "keyed-assignment", "medium", ["=", ":"],
        r"""(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|credential)\w*["']?\s*[:=]\s*["']([A-Za-z0-9_\-+/=.]{12,})["']""",
    ),
]


def _detector_hits(text: Column, detector: SecretDetector) -> Column:
    found = F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(1))
    rows = F.transform(
        found,
        lambda m: F.struct(F.lit(detector.name).alias("detector"), F.lit(detector.confidence).alias("confidence"), m.alias("match")),
    )
    none = F.array().cast("array<struct<detector:string,confidence:string,match:string>>")
    return F.when(S.contains_any(text, detector.needles), rows).otherwise(none)


def scan_secrets(texts: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """Every secret in every line: keys, line, detector, confidence, severity, redacted match."""
    words = sorted({n for d in SECRET_DETECTORS for n in d.needles if n not in "=:"})
    maybe = S.contains_any(F.col(text), words) | F.col(text).rlike(
        r"(?i)(?:key|secret|token|passw|credential)\w*[\"']?\s*[:=]"
    )
    rows = lines(texts.filter(maybe), keys, text)
    line_text = F.col("text")
    hits = F.concat(*[_detector_hits(line_text, d) for d in SECRET_DETECTORS])
    return rows.select(*keys, "line", F.inline(hits)).select(
        *keys,
        "line",
        "detector",
        "confidence",
        S.secret_severity("detector").alias("severity"),
        S.redact("match").alias("redacted"),
    )


def secret_findings(files: DataFrame) -> DataFrame:
    """Secrets in source files as findings, data-file policy not yet applied."""
    return make_findings(
        scan_secrets(files, ["repo", "path"]),
        repo="repo",
        tool=F.lit("gitleaks"),
        rule_id="detector",
        severity="severity",
        category=F.lit("secrets"),
        confidence="confidence",
        file="path",
        line="line",
        message=F.concat(F.lit("Secret in the text: "), F.col("redacted")),
    )
