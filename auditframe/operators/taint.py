"""Taint: line folds over single files and reachability across functions.

A fold walks one file's lines inside its row (``aggregate``), so file contents
are never shuffled. What leaves a file is small: sink hits, call edges and
function headers. Only those are joined, and the call graph is walked by a
frontier that visits each node once.

Python files are read as lines. JavaScript files are read as the scanner's
statements, not as syntax trees: comments are gone, calls and values may go on
over several lines, and blocks and the heads of loops and conditions are
statements of their own. Names live in their function, not in their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.operators.findings import concat_findings, make_findings
from auditframe.operators.joins import salted_join
from auditframe.session import durable
from auditframe.sources.config import repo_lists
from auditframe.sources.files import LINE_BREAK, listed
from auditframe.sources.scanner import scanned

IDENT = r"[A-Za-z_$][\w$]*+"
# A dotted name from its beginning. Without the look-behind every suffix of a long name would be tried.
DOTTED = rf"(?<![\w$])(?<![\w$]\.){IDENT}(?:\.{IDENT})*+"
FIX_PY = "Check or clean the input first: bound query parameters, argument lists instead of a shell, shlex.quote, path allow-lists."
FIX_JS = "Check or clean the input first: bound query parameters, argument arrays instead of a shell, normalised and allowed paths."
REFERENCE = "https://owasp.org/Top10/A03_2021-Injection/"


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for use several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _no(array_type: str) -> Column:
    return F.array().cast(f"array<{array_type}>")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))


# --- Python ----------------------------------------------------------------

PY_ASSIGN = r"^\s*([A-Za-z_]\w*)\s*=\s*(.+?)\s*$"
_PY_HIT = "struct<line:int,sink:string,category:string,via:string>"


def _py_line(text: Column, line: Column) -> Column:
    """Everything about a line that does not depend on what is tainted."""
    rest = F.regexp_replace(text, r"^\s*[A-Za-z_]\w*\s*=", "")
    rhs = F.regexp_extract(text, PY_ASSIGN, 2)
    assigns = text.rlike(PY_ASSIGN) & ~rest.rlike("[=!<>]=")
    sinks = []
    for pattern, category, name in V.PY_SINKS:
        # The region runs from the first parenthesis at or after the match.
        region = F.regexp_extract(F.regexp_extract(text, f"(?:{pattern}).*$", 0), r"\(.*$", 0)
        sinks.append(
            F.when(
                text.rlike(pattern) & ~region.rlike(V.PY_SANITIZER),
                F.struct(
                    F.lit(name).alias("name"),
                    F.lit(category).alias("category"),
                    region.rlike(V.PY_SOURCE).alias("src"),
                    _tokens(region).alias("tokens"),
                ),
            )
        )
    return F.struct(
        line.cast("int").alias("line"),
        F.when(assigns, F.regexp_extract(text, PY_ASSIGN, 1)).alias("var"),
        rhs.rlike(V.PY_SANITIZER).alias("clean"),
        rhs.rlike(V.PY_SOURCE).alias("src"),
        _tokens(rhs).alias("tokens"),
        F.array_compact(F.array(*sinks)).alias("sinks"),
    )


def py_taint_hits(content: str | Column = "content") -> Column:
    """array<struct<line, sink, category, via>> of one Python file; null ``via`` is direct input.

    Names stay tainted until they are assigned from a sanitiser; a plain
    reassignment does not clear them. The state spans the file.
    """
    relevant = "|".join([PY_ASSIGN] + [p for p, _, _ in V.PY_SINKS])
    numbered = F.filter(
        F.transform(
            F.split(S.col_of(content), LINE_BREAK, -1),
            lambda t, i: F.struct(t.alias("t"), (i + 1).alias("n")),
        ),
        lambda x: ~x["t"].rlike(r"^\s*#") & x["t"].rlike(relevant),
    )
    facts = F.transform(numbered, lambda x: _py_line(x["t"], x["n"]))
    start = F.struct(_no("string").alias("tainted"), _no(_PY_HIT).alias("hits"))

    def assign(tainted: Column, x: Column) -> Column:
        known = F.array_contains(tainted, x["var"])
        return (
            F.when(x["var"].isNull(), tainted)
            .when(x["clean"], F.array_remove(tainted, x["var"]))
            .when((x["src"] | F.arrays_overlap(x["tokens"], tainted)) & ~known, F.array_append(tainted, x["var"]))
            .otherwise(tainted)
        )

    def hits(tainted: Column, x: Column) -> Column:
        reached = F.filter(x["sinks"], lambda k: k["src"] | F.arrays_overlap(k["tokens"], tainted))
        return F.transform(
            reached,
            lambda k: F.struct(
                x["line"].alias("line"),
                k["name"].alias("sink"),
                k["category"].alias("category"),
                F.when(
                    ~k["src"], F.get(F.filter(tainted, lambda v: F.array_contains(k["tokens"], v)), F.lit(0))
                ).alias("via"),
            ),
        )

    def step(acc: Column, x: Column) -> Column:
        return _let(
            assign(acc["tainted"], x),
            lambda t: F.struct(
                t.alias("tainted"),
                F.when(F.size(x["sinks"]) == 0, acc["hits"])
                .otherwise(F.concat(acc["hits"], hits(t, x)))
                .alias("hits"),
            ),
        )

    return F.aggregate(facts, start, step)["hits"]


def py_taint(files: DataFrame) -> DataFrame:
    """(repo, file, line, sink, category, via) of Python files; files without input are skipped unread."""
    py = files.filter(listed(extensions=V.PY_EXTENSIONS)).filter(F.col("content").rlike(V.PY_SOURCE))
    return py.select("repo", F.col("path").alias("file"), F.inline(py_taint_hits()))


def py_taint_findings(files: DataFrame) -> DataFrame:
    reason = F.coalesce(F.concat(F.lit("the tainted name "), F.col("via")), F.lit("user input"))
    return make_findings(
        py_taint(files),
        repo="repo",
        tool=F.lit(V.CHECK_TAINT),
        rule_id=F.concat(F.lit(V.RULE_PREFIX + "taint."), F.col("category")),
        severity=F.lit("high"),
        category="category",
        confidence=F.lit("low"),
        file="file",
        line="line",
        message=F.concat(F.lit("Possible taint: "), reason, F.lit(" arrives at "), F.col("sink"), F.lit(" uncleaned.")),
        ai_relevant=F.lit(True),
        remediation=F.lit(FIX_PY),
        references=F.array(F.lit(REFERENCE)),
    )


# --- JavaScript: model of one file -----------------------------------------

# A header starts a function; groups: text before, name, parameters in one of
# three notations, text after.
JS_HEADER = (
    rf"^(.*?)(?:\bfunction\b\s*\*?\s*({IDENT})?\s*\(([^()]*)\)\s*"
    rf"|\(([^()]*)\)\s*=>\s*|\b({IDENT})\s*=>\s*)(.*)$"
)
JS_METHOD = (
    r"^\s*(?:(?:async|static|get|set)\s+)*(?!(?:if|for|while|switch|catch|function|return)\b)"
    rf"({IDENT})\s*\(([^()]*)\)\s*(\{{.*)$"
)
JS_NAME_BEFORE = rf"(?:^|[\s,{{])({IDENT})\s*[=:]\s*(?:async\s*)?$"
_LEAD = r"^[\s{}]*+(?:(?:else|do|try|finally|default\s*:|case\s[^:]*+:)[\s{]*+)*+"
JS_ASSIGN = rf"{_LEAD}(?:export\s+)?(?:(?:const|let|var)\s+)?({IDENT})\s*(?::\s*[\w<>\[\].]+\s*)?(\+?=)(?![=>])\s*(.*)$"
JS_DESTRUCTURE = _LEAD + r"(?:(?:const|let|var)\s*|\(\s*)?[\{\[]([^}\]]*)[}\]]\s*=(?![=>])\s*(.*)$"
# Heads of loops: what each turn binds, and the first value of a counter.
JS_EACH = rf"{_LEAD}for\s*(?:await\s*)?\(\s*(?:(?:const|let|var)\s+)?(?:({IDENT})|[\{{\[]([^}}\]]*)[}}\]])\s+(?:of|in)\s+(.*)\)$"
JS_COUNTER = rf"{_LEAD}for\s*\(\s*(?:const|let|var)\s+({IDENT})\s*=(?!=)\s*([^;]*+);.*$"
# Calls with up to two levels of nested parentheses. Possessive, so long lines
# cost neither backtracking nor stack.
_ARGS = r"((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)"
JS_CALL = rf"({DOTTED})\s*+\({_ARGS}"
JS_KEYWORDS = [
    "if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "require", "import", "super",
]
_TAINT = "struct<v:string,o:string>"
_JS_HIT = "struct<fn:int,line:int,callee:string,full:boolean,origin:string,via:string>"
_JS_EDGE = "struct<fn:int,line:int,callee:string,arg:int,origin:string>"
_JS_FRAME = f"struct<fn:int,at:int,tainted:array<{_TAINT}>>"


def default_taint() -> dict[str, list[str]]:
    return {key: values for (scope, key), values in V.DEFAULT_CONFIG.items() if scope == "taint"}


def _without_strings(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r'"[^"]*+"', '""'), r"'[^']*+'", "''")


def _without_calls(text: Column) -> Column:
    """Drop call results (they count as clean) and unwrap plain parentheses."""

    def dropped(t: Column) -> Column:
        for _ in range(3):
            t = F.regexp_replace(t, rf"{DOTTED}\s*+\([^()]*+\)", " ")
            t = F.regexp_replace(t, r"\(([^()]*+)\)", " $1 ")
        return t

    return _let(text, lambda t: F.when(t.contains("("), dropped(t)).otherwise(t))


def _value(text: Column, source: Column) -> Column:
    """struct(src, named, tokens) of an expression: does it read input, from what, and which names does it use."""

    def described(t: Column, named: Column) -> Column:
        return F.struct(
            (named != "").alias("src"),
            named.alias("named"),
            F.regexp_extract_all(t, F.lit(rf"(?:^|[^.\w$])({IDENT})"), F.lit(1)).alias("tokens"),
        )

    return _let(text, lambda t: _let(F.call_function("regexp_extract", t, source, F.lit(1)), lambda n: described(t, n)))


def _names(text: Column, keep_positions: bool) -> Column:
    """Identifiers of a parameter or destructuring list."""
    plain = F.transform(
        F.split(text, ",", -1),
        lambda p: F.regexp_replace(F.regexp_replace(S.strip(p), r"^\.\.\.", ""), r"\s*=.*$", ""),
    )
    if keep_positions:
        named = F.transform(plain, lambda p: F.regexp_replace(p, r"\??\s*:.*$", ""))
        return F.transform(named, lambda p: F.when(p.rlike(f"^{IDENT}$"), p).otherwise(F.lit("")))
    named = F.transform(plain, lambda p: S.strip(F.substring_index(p, ":", -1)))
    return F.filter(named, lambda p: p.rlike(f"^{IDENT}$"))


def _statements(found: Column) -> Column:
    """array<struct<line, text, header, name, params>>: the scanner's statements, cut before and behind function headers."""
    part = "struct<line:int,text:string,header:boolean,name:string,params:array<string>>"

    def piece(text: Column, line: Column, name: Column | None = None, params: Column | None = None) -> Column:
        return F.struct(
            line.alias("line"), text.alias("text"), F.lit(name is not None).alias("header"),
            (F.lit("") if name is None else name).alias("name"), (_no("string") if params is None else params).alias("params"),
        )

    def cut(s: Column) -> Column:
        text, line = s["text"], s["line"]
        pre = F.regexp_extract(text, JS_HEADER, 1)
        name = F.coalesce(
            S.nonempty(F.regexp_extract(text, JS_HEADER, 2)), F.regexp_extract(pre, JS_NAME_BEFORE, 1)
        )
        params = F.concat(*[F.regexp_extract(text, JS_HEADER, g) for g in (3, 4, 5)])
        return (
            F.when(
                (text.contains("=>") | text.contains("function")) & text.rlike(JS_HEADER),
                F.array(piece(pre, line), piece(F.regexp_extract(text, JS_HEADER, 6), line, name, _names(params, True))),
            )
            .when(
                text.rlike(JS_METHOD),
                F.array(
                    piece(
                        F.regexp_extract(text, JS_METHOD, 3), line, F.regexp_extract(text, JS_METHOD, 1),
                        _names(F.regexp_extract(text, JS_METHOD, 2), True),
                    )
                ),
            )
            .otherwise(F.array(piece(text, line)))
        )

    rows = F.flatten(F.transform(found, cut))
    return F.filter(F.coalesce(rows, _no(part)), lambda s: s["header"] | (S.strip(s["text"]) != ""))


def _calls(text: Column) -> Column:
    """array<struct<callee, args>> of a statement, nested calls included."""

    def level(t: Column) -> Column:
        return F.when(t.contains("("), F.regexp_extract_all(t, F.lit(JS_CALL), F.lit(0))).otherwise(_no("string"))

    def inside(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda c: F.regexp_extract(c, JS_CALL, 2)), " ; ")

    def split(found: Column) -> Column:
        return F.transform(
            found,
            lambda c: F.struct(
                F.regexp_extract(c, JS_CALL, 1).alias("callee"), F.regexp_extract(c, JS_CALL, 2).alias("args")
            ),
        )

    return _let(
        level(text),
        lambda one: _let(
            level(inside(one)), lambda two: F.concat(split(one), split(two), split(level(inside(two))))
        ),
    )


Lists = dict[str, list[str] | Column]


def _source_pattern(sources: list[str] | Column) -> Column:
    """Any of the sources as a whole dotted name; none at all matches nothing."""
    if isinstance(sources, list):
        any_of = F.lit(S.any_literal(sources) if sources else "(?!)")
    else:
        quoted = F.transform(sources, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E")))
        any_of = F.when(F.size(sources) == 0, F.lit("(?!)")).otherwise(F.array_join(quoted, "|"))
    return F.concat(F.lit(r"(?:^|[^.\w$])("), any_of, F.lit(r")(?![\w$])"))


def _is_in(name: Column, names: list[str] | Column, last: bool = False) -> Column:
    """Whether a callee is one of the names, or ends as one of them does."""
    if isinstance(names, list):
        return name.isin(sorted({x.rsplit(".", 1)[-1] for x in names}) if last else names)
    return F.exists(names, lambda x: (S.last_segment(x) if last else x) == name)


def _facts(s: Column, config: Lists, source: Column) -> Column:
    """Everything about a statement that does not depend on what is tainted; ``source`` is the pattern of what is input.

    Lambdas are interpreted, and a value named twice in one is computed twice: texts and matches are bound first.
    """

    def values(args: Column) -> Column:
        return F.transform(F.split(_without_calls(args), ",", -1), lambda a: _value(a, source))

    def sink(callee: Column, last: Column) -> Column:
        return (_is_in(last, config["sinks"], last=True) | _is_in(callee, config["sinks"])) & ~_is_in(last, config["sanitizers"], last=True)

    def calls(text: Column) -> Column:
        sorted_out = F.filter(
            F.transform(
                _calls(text),
                lambda c: F.struct(
                    c["callee"].alias("callee"),
                    _let(S.last_segment(c["callee"]), lambda last: sink(c["callee"], last)).alias("sink"),
                    _is_in(c["callee"], config["sinks"]).alias("full"),
                    (~c["callee"].contains(".") & ~c["callee"].isin(JS_KEYWORDS)).alias("local"),
                    c["args"].alias("args"),
                ),
            ),
            lambda c: c["sink"] | c["local"],
        )
        return F.transform(sorted_out, lambda c: c.withField("args", values(c["args"])))

    def count(text: Column, ch: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))

    def kinds(text: Column) -> Column:
        loop, value = text.contains("for"), text.contains("=")
        return F.struct(
            (loop & text.rlike(JS_EACH)).alias("each"), (loop & text.rlike(JS_COUNTER)).alias("counter"),
            (value & text.rlike(JS_DESTRUCTURE)).alias("destructured"), (value & text.rlike(JS_ASSIGN)).alias("assigned"),
        )

    def facts(text: Column, kind: Column) -> Column:
        each, counter, destructured, assigned = (kind[k] for k in ("each", "counter", "destructured", "assigned"))
        unpacked = F.when(each, F.regexp_extract(text, JS_EACH, 2)).otherwise(F.regexp_extract(text, JS_DESTRUCTURE, 1))
        named = (
            F.when(each, F.regexp_extract(text, JS_EACH, 1))
            .when(counter, F.regexp_extract(text, JS_COUNTER, 1))
            .otherwise(F.lit(""))
        )
        rhs = (
            F.when(each, F.regexp_extract(text, JS_EACH, 3))
            .when(counter, F.regexp_extract(text, JS_COUNTER, 2))
            .when(destructured, F.regexp_extract(text, JS_DESTRUCTURE, 2))
            .when(assigned, F.regexp_extract(text, JS_ASSIGN, 3))
            .otherwise(F.lit(""))
        )
        binds = F.when(each | counter, named != "").otherwise(F.lit(False))
        return F.struct(
            s["line"].alias("line"),
            s["header"].alias("header"),
            s["params"].alias("params"),
            (count(text, "{") - count(text, "}")).alias("braces"),
            F.when(binds, F.array(named))
            .when(each | (destructured & ~counter), _names(unpacked, False))
            .when(assigned, F.array(F.regexp_extract(text, JS_ASSIGN, 1)))
            .otherwise(_no("string"))
            .alias("vars"),
            (binds | (assigned & ~each & ~destructured & (F.regexp_extract(text, JS_ASSIGN, 2) == "="))).alias("replaces"),
            _value(_without_calls(rhs), source).alias("value"),
            calls(text).alias("calls"),
        )

    return _let(_without_strings(s["text"]), lambda text: _let(kinds(text), lambda kind: facts(text, kind)))


def _flow(facts: Column) -> Column:
    """Fold statements to struct(hits, edges).

    Frames follow braces: a header opens a function whose parameters taint
    themselves, so one pass yields what happens for every tainted parameter.
    The origin of a taint is a parameter name, or '' for input read here.
    """
    module = F.struct(F.lit(0).alias("fn"), F.lit(-1).alias("at"), _no(_TAINT).alias("tainted"))
    start = F.struct(
        F.lit(0).alias("depth"), F.array(module).alias("frames"),
        _no(_JS_HIT).alias("hits"), _no(_JS_EDGE).alias("edges"),
    )

    def origins(value: Column, tainted: Column) -> Column:
        """array<struct<v, o>> feeding a value; for input read in place v is what it is read from, with a space in front."""
        read = F.struct(F.concat(F.lit(" "), value["named"]).alias("v"), F.lit("").alias("o"))
        direct = F.when(value["src"], F.array(read)).otherwise(_no(_TAINT))
        return F.concat(direct, F.filter(tainted, lambda t: F.array_contains(value["tokens"], t["v"])))

    def hits(x: Column, fn: Column, tainted: Column) -> Column:
        return F.flatten(
            F.transform(
                F.filter(x["calls"], lambda c: c["sink"]),
                lambda c: F.transform(
                    F.array_distinct(F.flatten(F.transform(c["args"], lambda a: origins(a, tainted)))),
                    lambda t: F.struct(
                        fn.alias("fn"), x["line"].alias("line"), c["callee"].alias("callee"),
                        c["full"].alias("full"), t["o"].alias("origin"), t["v"].alias("via"),
                    ),
                ),
            )
        )

    def edges(x: Column, fn: Column, tainted: Column) -> Column:
        return F.flatten(
            F.transform(
                F.filter(x["calls"], lambda c: c["local"]),
                lambda c: F.flatten(
                    F.transform(
                        c["args"],
                        lambda a, i: F.transform(
                            origins(a, tainted),
                            lambda t: F.struct(
                                fn.alias("fn"), x["line"].alias("line"), c["callee"].alias("callee"),
                                i.cast("int").alias("arg"), t["o"].alias("origin"),
                            ),
                        ),
                    )
                ),
            )
        )

    def assign(x: Column, tainted: Column) -> Column:
        kept = F.when(x["replaces"], F.filter(tainted, lambda t: ~F.array_contains(x["vars"], t["v"]))).otherwise(tainted)
        gained = F.flatten(
            F.transform(
                x["vars"],
                lambda v: F.transform(
                    origins(x["value"], tainted), lambda t: F.struct(v.alias("v"), t["o"].alias("o"))
                ),
            )
        )
        return F.when(F.size(x["vars"]) == 0, tainted).otherwise(F.array_distinct(F.concat(kept, gained)))

    def open_frame(acc: Column, x: Column) -> Column:
        params = F.filter(x["params"], lambda p: p != "")
        frame = F.struct(
            x["line"].alias("fn"), acc["depth"].alias("at"),
            F.transform(params, lambda p: F.struct(p.alias("v"), p.alias("o"))).alias("tainted"),
        )
        return F.when(x["header"], F.array_append(acc["frames"], frame)).otherwise(acc["frames"])

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + x["braces"]

        def in_frame(frames: Column) -> Column:
            top = F.get(frames, F.size(frames) - 1)
            moved = F.struct(top["fn"].alias("fn"), top["at"].alias("at"), assign(x, top["tainted"]).alias("tainted"))
            stack = F.concat(F.slice(frames, 1, F.greatest(F.size(frames) - 1, F.lit(0))), F.array(moved))
            return F.struct(
                depth.alias("depth"),
                F.filter(stack, lambda f: f["at"] < depth).alias("frames"),
                F.when(F.size(x["calls"]) == 0, acc["hits"])
                .otherwise(F.concat(acc["hits"], hits(x, top["fn"], top["tainted"]))).alias("hits"),
                F.when(F.size(x["calls"]) == 0, acc["edges"])
                .otherwise(F.concat(acc["edges"], edges(x, top["fn"], top["tainted"]))).alias("edges"),
            )

        return _let(open_frame(acc, x), in_frame)

    return F.aggregate(facts, start, step, lambda end: F.struct(end["hits"].alias("hits"), end["edges"].alias("edges")))


def _matches(content: Column, pattern: str) -> Column:
    """Every match of a pattern about imports or exports; a text without the word is not searched."""
    word = next(w for w in ("export", "import", "require") if w in pattern)
    return F.when(~content.contains(word), _no("string")).otherwise(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)))


def _pairs(content: Column, pattern: str, first: int, second: int | None, fixed: str | None = None) -> Column:
    """array<struct<a, b>> from two groups of every match; ``fixed`` replaces the second."""
    return F.transform(
        _matches(content, pattern),
        lambda m: F.struct(
            F.regexp_extract(m, pattern, first).alias("a"),
            (F.lit(fixed) if second is None else F.regexp_extract(m, pattern, second)).alias("b"),
        ),
    )


def _listed_pairs(content: Column, pattern: str, separator: str, tail: int | None = None) -> Column:
    """Pairs from brace lists such as ``a as b, c``; a name alone stands for both.

    With ``tail`` the group holding the module source is added as third field.
    """

    def entry(m: Column, item: Column) -> Column:
        left = S.strip(F.regexp_extract(item, rf"^\s*({IDENT})", 1))
        right = F.coalesce(S.nonempty(F.regexp_extract(item, rf"{separator}\s*({IDENT})\s*$", 1)), left)
        fields = [left.alias("a"), right.alias("b")]
        if tail is not None:
            fields.append(F.regexp_extract(m, pattern, tail).alias("c"))
        return F.struct(*fields)

    return F.flatten(
        F.transform(
            _matches(content, pattern),
            lambda m: F.filter(
                F.transform(F.split(F.regexp_extract(m, pattern, 1), ",", -1), lambda i: entry(m, i)),
                lambda e: e["a"] != "",
            ),
        )
    )


_FROM = r"""['"]([^'"]+)['"]"""
_REQUIRE = rf"require\(\s*{_FROM}\s*\)"


def _imports(content: Column) -> Column:
    """array<struct<local, source, imported>>."""
    named = _listed_pairs(content, rf"\bimport\s*(?:{IDENT}\s*,\s*)?\{{([^}}]*)\}}\s*from\s*{_FROM}", r"\bas", 2)
    unpacked = _listed_pairs(content, rf"\b(?:const|let|var)\s*\{{([^}}]*)\}}\s*=\s*{_REQUIRE}", ":", 2)
    default = _pairs(content, rf"\bimport\s+({IDENT})\s*(?:,\s*\{{[^}}]*\}}\s*)?from\s*{_FROM}", 1, 2)
    whole = _pairs(content, rf"\b(?:const|let|var)\s+({IDENT})\s*=\s*{_REQUIRE}", 1, 2)

    def triple(local: Column, source: Column, imported: Column) -> Column:
        return F.struct(local.alias("local"), source.alias("source"), imported.alias("imported"))

    return F.concat(
        F.transform(F.concat(named, unpacked), lambda e: triple(e["b"], e["c"], e["a"])),
        F.transform(default, lambda e: triple(e["a"], e["b"], F.lit("default"))),
        F.transform(whole, lambda e: triple(e["a"], e["b"], F.lit("*"))),
    )


def _exports(content: Column) -> Column:
    """array<struct<exported, local>>."""
    no_name = r"(?!(?:function|async|class|new|require|await)\b)"
    declared = F.concat(
        _pairs(content, rf"\bexport\s+(?:async\s+)?function\s*\*?\s*({IDENT})", 1, 1),
        _pairs(content, rf"\bexport\s+(?:const|let|var)\s+({IDENT})", 1, 1),
        _pairs(content, rf"\bexports\.({IDENT})\s*=\s*{no_name}({IDENT})", 1, 2),
        _listed_pairs(content, r"\bmodule\.exports\s*=\s*\{([^}]*)\}", ":"),
    )
    renamed = _listed_pairs(content, r"\bexport\s*\{([^}]*)\}", r"\bas")
    default = F.concat(
        _pairs(content, rf"\bexport\s+default\s+(?:async\s+)?(?:function\b\s*\*?\s*|class\s+)?{no_name}({IDENT})", 1, None, "default"),
        _pairs(content, rf"\bmodule\.exports\s*=\s*{no_name}({IDENT})\s*;?", 1, None, "default"),
    )

    def pair(exported: Column, local: Column) -> Column:
        return F.struct(exported.alias("exported"), local.alias("local"))

    return F.concat(
        F.transform(declared, lambda e: pair(e["a"], e["b"])),
        F.transform(renamed, lambda e: pair(e["b"], e["a"])),
        F.transform(default, lambda e: pair(e["b"], e["a"])),
    )


def js_models(
    files: DataFrame, config: dict[str, list[str]] | DataFrame | None = None, max_bytes: int | None = None
) -> DataFrame:
    """One small row per JS/TS file: functions, imports, exports, sink hits, call edges.

    Files of any size are read unless ``max_bytes`` is given. ``config`` holds lists for all files, or is a table (from
    ``overlay_config``) with lists of repositories' own; source text moves only if that table is too large to be sent to all tasks.
    """
    lists: Lists = config if isinstance(config, dict) else default_taint()
    own: list[Column] = []
    source = _source_pattern(lists["sources"])
    if isinstance(config, DataFrame):
        # Little text is much work here: by its bytes alone it would be left to a few tasks.
        n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        files = salted_join(files, repo_lists(config, "taint"), ["repo"], ["path"], tasks=n)
        merged = {k: F.coalesce(F.col(f"cfg_{k}"), F.array(*[F.lit(x) for x in v]).cast("array<string>")) for k, v in lists.items()}
        own = [*[c.alias(f"cfg_{k}") for k, c in merged.items()], _source_pattern(merged["sources"]).alias("__source")]
        lists, source = {k: F.col(f"cfg_{k}") for k in lists}, F.col("__source")
    js = files.filter(listed(extensions=V.JS_EXTENSIONS))
    if max_bytes is not None:
        js = js.filter(F.octet_length("content") <= max_bytes)
    parsed = js.select(
        "repo",
        "path",
        scanned(F.col("content"), "js", split=True)["statements"].alias("found"),
        _imports(F.col("content")).alias("imports"),
        _exports(F.col("content")).alias("exports"),
        *own,
    ).withColumn("statements", _statements(F.col("found")))
    return parsed.select(
        "repo",
        "path",
        F.transform(
            F.filter("statements", lambda s: s["header"]),
            lambda s: F.struct(s["name"].alias("name"), s["line"].alias("fn"), s["params"].alias("params")),
        ).alias("functions"),
        "imports",
        "exports",
        _flow(F.transform("statements", lambda s: _facts(s, lists, source))).alias("flow"),
    )


# --- JavaScript: across files ----------------------------------------------


def functions(models: DataFrame) -> DataFrame:
    """Named functions, the first definition of a name in a file wins."""
    rows = models.select("repo", "path", F.inline("functions")).filter(F.col("name") != "")
    return rows.groupBy("repo", "path", "name").agg(F.min(F.struct("fn", "params")).alias("f")).select(
        "repo", "path", "name", "f.fn", "f.params"
    )


def resolve_imports(models: DataFrame) -> DataFrame:
    """(repo, path, source, target): the first existing candidate of each relative import."""
    wanted = (
        models.select("repo", "path", F.explode("imports.source").alias("source"))
        .distinct()
        .select("repo", "path", "source", F.posexplode(S.import_candidates("source", "path")).alias("pos", "target"))
    )
    existing = models.select("repo", F.col("path").alias("target"))
    return (
        wanted.join(existing, ["repo", "target"])
        .groupBy("repo", "path", "source")
        .agg(F.min_by("target", "pos").alias("target"))
    )


def call_targets(models: DataFrame, calls: DataFrame) -> DataFrame:
    """Resolve (repo, path, callee) to (target, fn, params): own file first, then imports.

    ``calls`` holds distinct callees, so no call site takes part in the joins.
    """
    defined = functions(models)
    own = defined.select(
        "repo", "path", F.col("name").alias("callee"), F.col("fn").alias("own_fn"), F.col("params").alias("own_params")
    )
    imported = (
        models.select("repo", "path", F.inline("imports"))
        .groupBy("repo", "path", F.col("local").alias("callee"))
        .agg(F.min(F.struct("source", "imported")).alias("i"))
        .select("repo", "path", "callee", "i.source", "i.imported")
    )
    exported = (
        models.select("repo", F.col("path").alias("target"), F.inline("exports"))
        .groupBy("repo", "target", F.col("exported").alias("imported"))
        .agg(F.min("local").alias("local"))
    )
    elsewhere = (
        imported.join(resolve_imports(models), ["repo", "path", "source"])
        .join(exported, ["repo", "target", "imported"], "left")
        .withColumn("name", F.coalesce("local", "imported"))
        .join(
            defined.select("repo", F.col("path").alias("target"), "name", F.col("fn").alias("far_fn"), F.col("params").alias("far_params")),
            ["repo", "target", "name"],
        )
        .select("repo", "path", "callee", "target", "far_fn", "far_params")
    )
    keys = ["repo", "path", "callee"]
    joined = calls.select(*keys).distinct().join(own, keys, "left").join(elsewhere, keys, "left")
    return joined.filter(F.col("own_fn").isNotNull() | F.col("far_fn").isNotNull()).select(
        *keys,
        F.when(F.col("own_fn").isNotNull(), F.col("path")).otherwise(F.col("target")).alias("target"),
        F.coalesce("own_fn", "far_fn").alias("target_fn"),
        F.when(F.col("own_fn").isNotNull(), F.col("own_params")).otherwise(F.col("far_params")).alias("params"),
    )


def node(repo, path, fn, param) -> Column:
    return F.concat_ws("\u0001", S.col_of(repo), S.col_of(path), S.col_of(fn).cast("string"), S.col_of(param))


def call_edges(models: DataFrame) -> DataFrame:
    """Taint-carrying calls: (repo, path, fn, line, callee, origin, target, target_fn, param).

    A null-free ``origin`` of '' means input read in the caller itself.
    """
    sites = models.select("repo", "path", F.inline("flow.edges"))
    resolved = sites.join(call_targets(models, sites), ["repo", "path", "callee"])
    return (
        resolved.withColumn("param", F.get("params", F.col("arg")))
        .filter(F.coalesce(F.col("param") != "", F.lit(False)))
        .filter((F.col("path") != F.col("target")) | (F.col("fn") != F.col("target_fn")))
        .select("repo", "path", "fn", "line", "callee", "origin", "target", "target_fn", "param")
        .distinct()
    )


EDGE_SALTS = 8


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reachable from ``seeds(node)`` over ``edges(src, dst)``, seeds included.

    Edges are dealt out once by (src, salt) and the nodes seen by node, and both keep that partitioning through their
    checkpoints: a round moves only the newest nodes and what they lead to. Nodes not seen before go on, so cycles end and
    no path is listed twice. A node with very many edges is spread over salts. Rounds are checkpointed: the plan
    stays flat and a lost executor costs no earlier round.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("dst"), F.lit(EDGE_SALTS)).cast("int")
    table = durable(edges.select("src", "dst").distinct().withColumn("salt", salt).repartition(n, "src", "salt"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(EDGE_SALTS)]))
    frontier = durable(seeds.select("node").distinct().repartition(n, "node"))
    visited = frontier
    while not frontier.isEmpty():
        starts = frontier.select(F.col("node").alias("src"), salts.alias("salt"))
        found = table.join(starts, ["src", "salt"]).select(F.col("dst").alias("node")).distinct()
        frontier = durable(found.repartition(n, "node").join(visited, "node", "left_anti"))
        visited = visited.unionByName(frontier)
    return visited


def js_taint(files: DataFrame, config: dict[str, list[str]] | DataFrame | None = None) -> DataFrame:
    """(repo, file, line, callee, confidence, via, crossed, direct) of JS/TS files.

    Input used in the function that reads it: medium if the sink is named in
    full, else low. Input that arrives through a parameter: low. Per file, line
    and sink name the more certain hit stays. ``via`` is the tainted name, or what input is read from, such as ``req.query``;
    ``direct`` tells the second.
    """
    models = durable(js_models(files, config))
    hits = models.select("repo", "path", F.inline("flow.hits"))
    edges = call_edges(models)
    keyed = edges.select(
        "origin",
        node("repo", "path", "fn", "origin").alias("src"),
        node("repo", "target", "target_fn", "param").alias("dst"),
    )
    keyed = durable(keyed.distinct())
    reached = reach(
        keyed.filter(F.col("origin") != ""), keyed.filter(F.col("origin") == "").select(F.col("dst").alias("node"))
    )
    direct = hits.filter(F.col("origin") == "").withColumn("crossed", F.lit(False))
    crossed = (
        hits.filter(F.col("origin") != "")
        .withColumn("node", node("repo", "path", "fn", "origin"))
        .join(reached, "node", "left_semi")
        .drop("node")
        .withColumn("crossed", F.lit(True))
    )
    both = direct.unionByName(crossed).withColumn("last", S.last_segment("callee"))
    certain = ~F.col("crossed") & F.col("full")
    best = F.min(F.struct((~certain).alias("unsure"), "crossed", "callee", "via")).alias("b")
    return both.groupBy("repo", F.col("path").alias("file"), "line", "last").agg(best).select(
        "repo", "file", "line", F.col("b.callee").alias("callee"),
        F.when(F.col("b.unsure"), F.lit("low")).otherwise(F.lit("medium")).alias("confidence"),
        F.ltrim("b.via").alias("via"), F.col("b.crossed").alias("crossed"), F.startswith(F.col("b.via"), F.lit(" ")).alias("direct"),
    )


def js_taint_findings(files: DataFrame, config: dict[str, list[str]] | DataFrame | None = None) -> DataFrame:
    reason = F.when(F.col("direct"), F.concat(F.lit("user input ("), "via", F.lit(")"))).otherwise(F.concat(F.lit("the tainted name "), "via"))
    hits = js_taint(files, config).withColumn("category", S.sink_category(S.last_segment("callee")))
    return make_findings(
        hits,
        repo="repo",
        tool=F.lit(V.CHECK_TAINT),
        rule_id=F.concat(F.lit(V.RULE_PREFIX + "taint."), F.col("category")),
        severity=F.lit("high"),
        category="category",
        confidence="confidence",
        file="file",
        line="line",
        message=F.concat(
            F.lit("Possible taint: "), reason, F.lit(" arrives at "), F.col("callee"), F.lit("()"),
            F.when(F.col("crossed"), F.lit(" through a function parameter")).otherwise(F.lit("")),
            F.lit(" uncleaned."),
        ),
        ai_relevant=F.lit(True),
        remediation=F.lit(FIX_JS),
        references=F.array(F.lit(REFERENCE)),
    )


def taint_findings(files: DataFrame, config: dict[str, list[str]] | DataFrame | None = None) -> DataFrame:
    return concat_findings(py_taint_findings(files), js_taint_findings(files, config))
