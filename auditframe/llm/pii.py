"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import fresh, stored

KINDS = ("email", "ip", "card", "phone")
# What counts as a base span, in forms that read every text once. A look-behind starts a match
# only where a run of the class starts or the last match ended, and possessive repeats never go back, so very
# long runs cost no more than short ones; both leave the leftmost matches as they are.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Spellings that the base patterns do not know; whether they are kept is learned.
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(\x20.-])(?:\x20|^)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: A text without this cannot hold a match.
_NEEDS = {("email", "base"): "@", ("phone", "base"): "+", ("email", "loose"): "at", ("ip", "loose"): ":"}
#: Gazetteers: top-level domains, card issuers, country codes, networks that are nobody's address.
DOMAIN_ENDS = r"\.(?:com|org|net|edu|gov|info|io|co|biz|de|fr|es|uk|it|nl|eu|us|ca|au|jp|ch|at|be)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|3[689]|35|6011|65|62)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NO_ADDRESS = r"^(?:0|127|255|22[4-9]|23[0-9])\."
#: Words just before a span that speak for its kind, or against any kind.
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|courriel|correo|from|to)\W*$",
    "ip": r"(?i)(?:\bip|address|addr|host|server|from|client|adresse)\W*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|karte|carte|tarjeta)\W*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono)\W*$",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|sku|serial|token|sha|hash|build|release|\bv|no|id)\W*$"
_REACH = 32
_BLOCK = 256


def _starts(lengths: Column) -> Column:
    """Sum of all elements before each one, in time near linear: prefixes within blocks, and of the blocks."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
        lambda i: F.slice(lengths, i * _BLOCK + 1, F.lit(_BLOCK)),
    )
    zero = F.lit(0).cast("long")
    nothing = F.array().cast("array<long>")
    prefix = lambda xs, base: F.aggregate(
        xs,
        F.struct(base.alias("at"), nothing.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, prefix(sums, zero), prefix))


_SPANS = "array<struct<start:long,end:long,found:string,ahead:string>>"


def _matches(text: Column, pattern: str, needs: str | None) -> Column:
    """Matches with their places in code points and the text just before them.

    ``split`` gives what stands between the matches of ``regexp_extract_all``; the lengths of both are the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(between.alias("gap"), found.alias("found"))
    lengths = F.transform(
        pairs, lambda p: (F.length(p["gap"]) + F.coalesce(F.length(p["found"]), F.lit(0))).cast("long")
    )
    spans = F.transform(
        F.filter(
            F.arrays_zip(between.alias("gap"), found.alias("found"), _starts(lengths).alias("at")),
            lambda p: p["found"].isNotNull(),
        ),
        lambda p: F.struct(
            (p["at"] + F.length(p["gap"])).alias("start"),
            (p["at"] + F.length(p["gap"]) + F.length(p["found"])).alias("end"),
            p["found"].alias("found"),
            F.substring(p["gap"], -_REACH, _REACH).alias("ahead"),
        ),
    )
    worth = F.contains(text, F.lit(needs)) if needs else F.lit(True)
    return F.when(worth & (F.regexp_instr(text, F.lit(pattern)) > 0), spans).otherwise(F.array().cast(_SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of 13 to 19 digits is right."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: (d.cast("int") * (i % 2 + 1)) - F.when(d.cast("int") * (i % 2 + 1) > 9, 9).otherwise(0),
        ),
        F.lit(0),
        lambda s, x: s + x,
    )
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _holds(kind: str, found: Column) -> Column:
    """The test that a base match must pass."""
    if kind == "ip":
        return F.regexp_like(found, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return _luhn(F.regexp_replace(found, "[^0-9]", ""))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, loose: bool, found: Column, ahead: Column, holds: Column) -> list[Column]:
    """One vote of each labeler: 1 for personal data, -1 against, 0 for no opinion."""
    never, digits = F.lit(False), _digits(found)
    regex = F.lit(0) if loose else _vote(holds, ~holds)
    like = lambda value, pattern: F.regexp_like(value, F.lit(pattern))
    if kind == "email":
        known = like(F.lower(F.regexp_replace(found, r"\x20?(?:\[dot\]|\(dot\))\x20?", ".")), DOMAIN_ENDS)
        gazetteer, shape = _vote(known, ~known), _vote(like(found, r"^[A-Za-z0-9]"), F.length(found) > 120)
    elif kind == "ip":
        gazetteer = _vote(never, like(found, NO_ADDRESS))
        shape = _vote(like(found, r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$|:.*:"), like(found, r"(?:^|\.)0[0-9]"))
    elif kind == "card":
        gazetteer = _vote(like(digits, ISSUERS), ~like(digits, ISSUERS))
        shape = _vote(like(found, r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})$"), (F.length(digits) > 19) | (F.length(digits) < 13))
    else:
        gazetteer = F.lit(0) if loose else _vote(like(found, COUNTRIES), ~like(found, COUNTRIES))
        shape = _vote(F.length(digits).between(10, 13), (F.length(digits) < 9) | (F.length(digits) > 15))
    context = _vote(like(ahead, CUES[kind]), like(ahead, AGAINST))
    return [regex, gazetteer, context, shape]


LABELERS = ("regex", "gazetteer", "context", "shape")
#: Values a span classifier's hashed features may take; the weight table is bounded by their number.
FEATURE_BUCKETS = 64
_CANDIDATES = "array<struct<kind:int,start:long,end:long,base:boolean,pattern:string,features:array<string>>>"


def _candidates(text: Column, k: int, kind: str, loose: bool) -> Column:
    spans = _matches(text, (LOOSE if loose else BASE)[kind], _NEEDS.get((kind, "loose" if loose else "base")))

    def one(s: Column) -> Column:
        holds = F.lit(False) if loose else _holds(kind, s["found"])
        votes = F.transform(F.array(*_votes(kind, loose, s["found"], s["ahead"], holds)), lambda v: v.cast("string"))
        # A loose match may carry the space before it.
        lead = F.length(s["found"]) - F.length(F.ltrim(s["found"]))
        shape = F.regexp_replace(F.regexp_replace(s["found"], "[0-9]+", "9"), "[A-Za-z]+", "a")
        word = F.lower(F.regexp_extract(s["ahead"], r"([^\s]*)\s*$", 1))
        hashed = lambda c, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(FEATURE_BUCKETS)).cast("string")
        return F.struct(
            F.lit(k).alias("kind"),
            (s["start"] + lead).cast("long").alias("start"),
            s["end"].alias("end"),
            holds.alias("base"),
            F.concat(F.lit(f"{k}:"), F.array_join(votes, ",")).alias("pattern"),
            F.array(
                F.lit(f"{k}:{int(loose)}"),
                F.concat(F.lit(f"{k}:shape:"), hashed(shape, 1)),
                F.concat(F.lit(f"{k}:word:"), hashed(word, 2)),
                F.concat(F.lit(f"{k}:digits:"), F.least(F.length(_digits(s["found"])), F.lit(30)).cast("string")),
            ).alias("features"),
        )

    return F.transform(spans, one).cast(_CANDIDATES)


def fit_labelers(counts: list[tuple[str, int]], rounds: int = 30) -> dict[str, float]:
    """Expectation-maximisation over vote patterns: the chance that a span of each pattern is personal data.

    ``counts`` has a row per kind and combination of votes, at most 4 * 3**4 in all. For every kind, each
    labeler's chances of voting -1, 0 or 1 on true and on false spans are estimated together with the share
    of true spans; the first guess is the mean vote.
    """
    posterior: dict[str, float] = {}
    for kind in sorted({p.split(":")[0] for p, _ in counts}):
        rows = [(p, [int(v) for v in p.split(":")[1].split(",")], n) for p, n in counts if p.split(":")[0] == kind]
        guess = {p: 1 / (1 + math.exp(-sum(votes))) for p, votes, _ in rows}
        for _ in range(rounds):
            true = sum(n * guess[p] for p, _, n in rows)
            every = sum(n for _, _, n in rows)
            prior = (true + 1) / (every + 2)
            chance = {}
            for j in range(len(LABELERS)):
                for v in (-1, 0, 1):
                    hit = sum(n * guess[p] for p, votes, n in rows if votes[j] == v)
                    miss = sum(n * (1 - guess[p]) for p, votes, n in rows if votes[j] == v)
                    # The prior keeps a vote's meaning: a labeler is better than chance unless the data deny it.
                    chance[j, v] = (
                        (hit + (4 if v == 1 else 1)) / (true + 6),
                        (miss + (4 if v == -1 else 1)) / (every - true + 6),
                    )
            for p, votes, _ in rows:
                odds = math.log(prior / (1 - prior))
                odds += sum(math.log(chance[j, v][0] / chance[j, v][1]) for j, v in enumerate(votes))
                guess[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        posterior |= guess
    return posterior


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    pairs = [x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``base_spans`` and ``pii_spans``: arrays of (kind, start, end) by kind, then start.

    Places are code points, the end exclusive; ``kind`` is an index into ``KINDS``. Base spans are the
    leftmost matches of each kind that pass its test; they are always kept. Further candidates are base
    matches that fail the test and looser spellings. Four labelers (patterns, gazetteers, words in front,
    shape) vote on all candidates; expectation-maximisation over the vote patterns estimates how far each
    labeler is right, and its posteriors train a naive Bayes classifier on the spans' own features. A
    further candidate is added if the mean of both log odds is positive and no base span and no addition of its kind
    kept before it overlaps it.

    A null or empty text has no spans. Rows are judged alone, so repeated rows and ids get equal answers;
    existing columns of the two names are replaced. Only DataFrame functions run on the executors; the
    driver sees the vote patterns (at most 324) and feature weights (bounded by ``FEATURE_BUCKETS``).
    """
    (cand, post, adds) = fresh(df, "cand", "post", "adds")
    df = df.drop("base_spans", "pii_spans")
    whole = F.coalesce(F.col(text), F.lit(""))
    every = [_candidates(whole, k, kind, False) for k, kind in enumerate(KINDS)]
    every += [_candidates(whole, KINDS.index(kind), kind, True) for kind in LOOSE]
    rest = [c for c in df.columns if c != text]
    judged = stored(df.select(*rest, F.concat(*every).alias(cand)), "pii")

    spans = judged.select(F.explode(cand).alias("c")).select("c.*")
    posterior = fit_labelers([tuple(r) for r in spans.groupBy("pattern").count().collect()])
    belief = _lookup(posterior, F.col("pattern"), 0.5)
    sums = (
        spans.select(belief.alias("p"), F.explode("features").alias("f"))
        .groupBy("f")
        .agg(F.sum("p").alias("hit"), F.sum(1 - F.col("p")).alias("miss"))
        .collect()
    )
    totals: dict[str, tuple[float, float]] = {}
    for r in sums:
        k, *rest_of_name = r["f"].split(":")
        if len(rest_of_name) == 1:  # every span has exactly one feature of this form
            hit, miss = totals.get(k, (0.0, 0.0))
            totals[k] = (hit + r["hit"], miss + r["miss"])
    weights = {}
    for r in sums:
        hit, miss = totals[r["f"].split(":")[0]]
        weights[r["f"]] = math.log((r["hit"] + 0.5) / (hit + 1)) - math.log((r["miss"] + 0.5) / (miss + 1))
    priors = {k: math.log((hit + 0.5) / (miss + 0.5)) for k, (hit, miss) in totals.items()}

    def score(c: Column) -> Column:
        own = F.aggregate(c["features"], F.lit(0.0), lambda s, f: s + _lookup(weights, f, 0.0))
        own = own + _lookup(priors, c["kind"].cast("string"), 0.0)
        p = F.greatest(F.least(_lookup(posterior, c["pattern"], 0.5), F.lit(1 - 1e-9)), F.lit(1e-9))
        return own + F.log(p / (1 - p))

    place = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.filter(F.col(cand), lambda c: c["base"])
    more = F.array_sort(F.transform(F.filter(F.col(cand), lambda c: ~c["base"] & (score(c) > 0)), place))
    free = F.filter(more, lambda m: ~F.exists(F.col(post), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    none = F.filter(F.col(adds), lambda m: F.lit(False))

    def keep(kept: Column, m: Column) -> Column:
        last = F.element_at(kept, -1)
        clear = (F.size(kept) == 0) | (last["kind"] != m["kind"]) | (last["end"] <= m["start"])
        return F.when(clear, F.array_append(kept, m)).otherwise(kept)

    chosen = F.when(F.size(adds) < 2, F.col(adds)).otherwise(F.aggregate(adds, none, keep))
    return (
        judged.withColumn(post, F.array_sort(F.transform(base, place)))
        .withColumn(adds, free)
        .withColumn(cand, chosen)
        .select(*rest, F.col(post).alias("base_spans"), F.array_sort(F.concat(post, cand)).alias("pii_spans"))
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
