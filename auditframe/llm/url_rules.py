"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import fresh

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than this are joined without a broadcast.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """A pattern over host and path written together.

    ``tokens`` are runs of a-z and 0-9 that stand whole, between other characters or ends, in
    every URL the pattern fits (compared in lower case). A rule without one is tried on every URL.
    ``named`` rules compete by length and are reported; the others only vote.
    """

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    named: bool


def site_rule(verdict: str, site: str) -> Rule:
    """A host with all its subdomains, and a prefix of the path, e.g. ``example.com/en/``."""
    host, slash, rest = site.partition("/")
    path = slash + rest
    tokens = re.findall("[a-z0-9]+", host.lower())
    whole = path if re.search("[^A-Za-z0-9]$", path) else path[: len(path) - len(re.search("[A-Za-z0-9]*$", path)[0])]
    tokens += re.findall("[a-z0-9]+", whole.lower())
    quoted = lambda s: re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)
    return Rule(site, rf"^(?:[^/]*\.)?{quoted(host)}{quoted(path)}", verdict, tuple(dict.fromkeys(tokens)), True)


def host_word_rule(verdict: str, word: str) -> Rule:
    """Any host that has the word as a token of its own, e.g. ``adult-x.example.com``."""
    return Rule(f"word:{word}", rf"^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9]|$)", verdict, (word,), False)


#: The rules of the registered query, and the words that decide where no rule fits.
SITES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
BLOCKED_WORDS = ("ads", "adult", "casino", "escort", "porn", "xxx")
DEFAULT_RULES = tuple(site_rule(*s) for s in SITES) + tuple(host_word_rule("block", w) for w in BLOCKED_WORDS)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_rows(spark, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.pattern).alias("pattern"),
            F.lit(r.verdict).alias("verdict"),
            F.array(*[F.lit(t) for t in (r.tokens or ("",))]).alias("tokens"),
            F.lit(r.named).alias("named"),
        )
        for r in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    Each distinct host and path is judged once. Its tokens fetch the rules indexed under them;
    a rule is indexed under that of its tokens which the fewest distinct addresses have. Only
    fetched rules run their pattern. The longest named rule that fits decides; where none fits,
    ``rule`` is null and the address is blocked if any other rule that fits says so, else allowed.

    A null url, or one without ``://``, has an empty host and path: no named rule fits it and it
    is allowed. Repeated urls get the same answer; columns of these four names are replaced.
    """
    spark = pages.sparkSession
    h, p, tok, n, got = fresh(pages, "host", "path", "token", "n", "got")
    host, path = url_parts(F.col(url))
    pages = pages.withColumns({h: host, p: path}).drop("host", "path", "rule", "verdict")
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    known = _rule_rows(spark, rules)

    target = F.concat(h, p)
    words = F.split(F.translate(target, _UPPER, _LOWER), "[^a-z0-9]+")
    words = F.array_union(F.array_distinct(words), F.array(F.lit("")))
    addresses = pages.select(h, p).distinct().withColumn(tok, F.explode(words))

    # The rarest token of each rule, counted over all addresses.
    spelled = known.select("rule", F.explode("tokens").alias(tok))
    counts = addresses.join(small(spelled.select(tok).distinct()), tok).groupBy(tok).agg(F.count("*").alias(n))
    index = (
        spelled.join(counts, tok, "left")
        .groupBy("rule")
        .agg(F.min_by(tok, F.struct(F.coalesce(n, F.lit(0)), tok)).alias(tok))
        .join(known.drop("tokens"), "rule")
    )

    fetched = addresses.join(small(index), tok).filter(F.expr(f"concat({h}, {p}) RLIKE pattern"))
    order = F.struct(F.length("rule"), F.col("rule"))
    judged = fetched.groupBy(h, p).agg(
        F.max_by(F.when(F.col("named"), F.struct("rule", "verdict")), F.when(F.col("named"), order)).alias(got),
        F.max(~F.col("named") & (F.col("verdict") == "block")).alias(n),
    )
    return (
        pages.join(judged, [h, p], "left")
        .withColumns(
            {
                "rule": F.col(f"{got}.rule"),
                "verdict": F.coalesce(
                    F.col(f"{got}.verdict"), F.when(F.col(n), F.lit("block")).otherwise(F.lit("allow"))
                ),
            }
        )
        .drop(got, n)
        .withColumnsRenamed({h: "host", p: "path"})
    )
