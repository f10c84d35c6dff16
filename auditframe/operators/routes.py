"""Web routes, guards and security signals of source files, and the checks built on them.

JavaScript routes are the calls that the scanner finds, with their arguments;
Python routes come from runs of decorator lines. Only routes and one row of flags
per repository are ever shuffled, never file contents.
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

# Methods and patterns of the route recipe.
JS_METHODS = ["get", "post", "put", "delete", "patch", "all", "head", "options"]
#: A name, a member or a call as an argument, whose last name counts; arguments come without what their brackets hold.
JS_GUARD = r"^(?:[A-Za-z_$][\w$]*(?:\(\)|\[\])*\s*\??\.\s*)*([A-Za-z_$][\w$]*)(?:\(\))*$"
PY_DECORATED_ROUTE = r"@\s*[\w.]+\.(route|get|post|put|delete|patch)\s*\("
PY_DEF = r"^(async\s+)?def\s+"
#: Found in every text that calls ``use``, whatever white space is around it; linear in the text.
JS_USES = r"\.[^\w.(]*+use[^\w.(]*+\("
WEB_FRAMEWORK = r"(?i)^(express|fastify|koa|flask|django|@hapi)"
_ROUTE_TYPE = "array<struct<framework:string,method:string,path:string,line:int,guards:array<string>>>"


def _guard_names(args: Column) -> Column:
    """Names that arguments stand for; functions and other expressions have none."""
    names = F.transform(
        args, lambda a: F.when(a.rlike(V.STRING_VALUE) & ~a.startswith("`"), F.substr(a, F.lit(2), F.length(a) - 2)).otherwise(F.regexp_extract(a, JS_GUARD, 1))
    )
    return F.filter(names, lambda n: (n != "") & ~n.isin("function", "async"))


def _rest(args: Column) -> Column:
    return F.slice(args, 2, F.greatest(F.size(args), F.lit(1)))


def _js_routes(calls: Column) -> Column:
    routed = F.filter(calls, lambda c: (c["name"] != "use") & F.get(c["args"], F.lit(0)).rlike(V.STRING_VALUE))
    return F.transform(
        routed,
        lambda c: F.struct(
            F.lit("express").alias("framework"),
            F.upper(c["name"]).alias("method"),
            F.substr(c["args"][0], F.lit(2), F.length(c["args"][0]) - 2).alias("path"),
            c["line"].alias("line"),
            _guard_names(_rest(c["args"])).alias("guards"),
        ),
    )


def _js_guards(calls: Column) -> Column:
    used = F.filter(calls, lambda c: c["name"] == "use")
    mounted = lambda c: F.coalesce(F.get(c["args"], F.lit(0)).rlike(V.STRING_VALUE), F.lit(False))
    named = F.transform(used, lambda c: _guard_names(F.when(mounted(c), _rest(c["args"])).otherwise(c["args"])))
    return F.array_distinct(F.flatten(named))


def _decorated(content: Column) -> Column:
    """Routes of one Python file: fold its lines, holding the open run of decorators.

    Blank and comment lines keep a run open, any other line ends it; a ``def``
    turns a run with a route decorator into a route.
    """
    stack_type = "array<struct<text:string,line:int>>"
    no_stack = F.array().cast(stack_type)
    numbered = F.filter(
        F.transform(
            F.split(content, LINE_BREAK, -1),
            lambda t, i: F.struct(S.strip(t).alias("text"), (i + 1).alias("line")),
        ),
        lambda x: (x["text"] != "") & ~x["text"].startswith("#"),
    )
    start = F.struct(no_stack.alias("stack"), F.array().cast(_ROUTE_TYPE).alias("found"))

    def route(stack: Column) -> Column:
        at = F.get(F.filter(stack, lambda d: d["text"].rlike(PY_DECORATED_ROUTE)), F.lit(0))
        method = F.regexp_extract(at["text"], r"\.(route|get|post|put|delete|patch)\s*\(", 1)
        others = F.filter(stack, lambda d: d["line"] != at["line"])
        guards = F.transform(others, lambda d: S.last_segment(F.regexp_extract(d["text"], r"@\s*([\w.]+)", 1)))
        return F.when(
            at.isNotNull(),
            F.struct(
                F.lit("flask").alias("framework"),
                F.when(method == "route", F.lit("ANY")).otherwise(F.upper(method)).alias("method"),
                F.regexp_extract(at["text"], r"""\(\s*['"]([^'"]+)['"]""", 1).alias("path"),
                at["line"].alias("line"),
                F.filter(guards, lambda g: g != "").alias("guards"),
            ),
        )

    def step(acc: Column, x: Column) -> Column:
        opens = x["text"].startswith("@")
        closes = x["text"].rlike(PY_DEF) & (F.size(acc["stack"]) > 0)
        return (
            F.when(
                opens,
                F.struct(F.array_append(acc["stack"], x).alias("stack"), acc["found"].alias("found")),
            )
            .when(
                closes,
                F.struct(
                    no_stack.alias("stack"),
                    F.concat(acc["found"], F.array_compact(F.array(route(acc["stack"])))).alias("found"),
                ),
            )
            .when(F.size(acc["stack"]) > 0, F.struct(no_stack.alias("stack"), acc["found"].alias("found")))
            .otherwise(acc)
        )

    return F.aggregate(numbered, start, step)["found"]


def route_facts(files: DataFrame, guards_only: bool = False) -> DataFrame:
    """One small row per analysed file: routes, global guards and signals.

    Source text is read once and does not go any further; routes, flags and
    all three checks are derived from these rows. With ``guards_only`` the rows
    are for ``global_guards`` alone: texts that never call ``use`` are not scanned.
    """
    content, is_py = F.col("content"), F.col("is_py")
    rows = files.filter(listed(extensions=V.JS_EXTENSIONS + V.PY_EXTENSIONS)).withColumn(
        "is_py", S.extension("path").isin(V.PY_EXTENSIONS)
    )
    read = ~is_py & content.rlike(JS_USES) if guards_only else ~is_py
    rows = rows.withColumn("js", scanned(F.when(read, content), "js", (*JS_METHODS, "use")))
    py = F.when(content.rlike(PY_DECORATED_ROUTE), _decorated(content)).otherwise(F.array().cast(_ROUTE_TYPE))
    if guards_only:
        return rows.select("repo", F.col("path").alias("file"), _js_guards(F.col("js.calls")).alias("use_guards"))
    return rows.select(
        "repo",
        F.col("path").alias("file"),
        F.when(is_py, py).otherwise(_js_routes(F.col("js.calls"))).alias("routes"),
        _js_guards(F.col("js.calls")).alias("use_guards"),
        *_signals(),
    )


def routes(facts: DataFrame) -> DataFrame:
    """(repo, file, line, framework, method, route, guards)."""
    own = _own(facts)
    return facts.select("repo", "file", *own, F.inline_outer("routes")).filter(F.col("line").isNotNull()).select(
        "repo", "file", "line", "framework", "method", F.col("path").alias("route"), "guards", *own
    )


def js_routes(facts: DataFrame) -> DataFrame:
    return routes(facts).filter(F.col("framework") == "express")


def py_routes(facts: DataFrame) -> DataFrame:
    return routes(facts).filter(F.col("framework") == "flask")


def global_guards(facts: DataFrame) -> DataFrame:
    """Distinct (repo, guard) applied with ``use``."""
    return facts.select("repo", F.explode_outer("use_guards").alias("guard")).filter("guard IS NOT NULL").distinct()


def _signals() -> list[Column]:
    """helmet, csp, hsts, rate_limit, web_import of one file; needs ``content``, ``js`` and ``is_py``.

    Fixed values: the names of libraries, headers and decorators in the patterns below.
    """
    content = F.col("content")
    code = F.array_join(F.transform("js.statements", lambda x: x["text"]), "\n")
    modules = F.concat(
        F.regexp_extract_all(code, F.lit(r"""\brequire\(\s*['"]([^'"]+)['"]"""), F.lit(1)),
        F.regexp_extract_all(code, F.lit(r"""(?m)^\s*import\b[^'"\n]*['"]([^'"]+)['"]"""), F.lit(1)),
    )
    py_modules = F.transform(
        F.concat(
            F.regexp_extract_all(content, F.lit(r"(?m)^\s*from\s+([\w.]+)\s+import"), F.lit(1)),
            F.regexp_extract_all(content, F.lit(r"(?m)^\s*import\s+([\w.]+)"), F.lit(1)),
        ),
        lambda m: F.substring_index(m, ".", 1),
    )

    def header(name: str) -> Column:
        return code.rlike(rf"""(?i:\.(?:setHeader|header|set))\(\s*['"][^'"]*(?i:{name})[^'"]*['"]""")

    def any_module(names: Column, pattern: str) -> Column:
        return F.exists(names, lambda m: m.rlike(pattern))

    headers_library = content.rlike(r"(?i)talisman|secure\b")
    is_py = F.col("is_py")
    return [
        F.when(is_py, headers_library)
        .otherwise(code.rlike(r"\bhelmet\s*\(|\.use\([^\n]*\bhelmet\b") | any_module(modules, "^helmet$"))
        .alias("helmet"),
        F.when(is_py, headers_library | content.rlike(r"""(?i)['"]Content-Security-Policy['"]"""))
        .otherwise(header("content-security-policy"))
        .alias("csp"),
        F.when(is_py, headers_library | content.rlike(r"""(?i)['"]Strict-Transport-Security['"]"""))
        .otherwise(header("strict-transport-security"))
        .alias("hsts"),
        F.when(is_py, content.rlike(r"(?i)flask_limiter|Limiter\s*\(|@\w*limiter\.limit"))
        .otherwise(any_module(modules, "(?i)(rate-limit|slow-down|rate-limiter-flexible)"))
        .alias("rate_limit"),
        F.when(is_py, any_module(py_modules, WEB_FRAMEWORK))
        .otherwise(any_module(modules, WEB_FRAMEWORK))
        .alias("web_import"),
    ]


def file_signals(facts: DataFrame) -> DataFrame:
    """Per analysed file: helmet, csp, hsts, rate_limit, web_import."""
    return facts.select("repo", F.col("file").alias("path"), "helmet", "csp", "hsts", "rate_limit", "web_import")


Names = list[str] | Column


def with_lists(facts: DataFrame, config: DataFrame) -> DataFrame:
    """Facts with the checker lists of their repository (``config`` from ``overlay_config``): columns ``cfg_<key>``."""
    return salted_join(facts, repo_lists(config, "checkers"), ["repo"], ["file"])


def _lists(facts: DataFrame, checks: dict[str, list[str]] | None) -> dict[str, Names]:
    """Each list as literals, or the repository's own where facts carry one."""
    plain = checks or default_checks()
    own = lambda key: F.coalesce(F.col(f"cfg_{key}"), F.array(*[F.lit(v) for v in plain[key]]).cast("array<string>"))
    return {key: own(key) if f"cfg_{key}" in facts.columns else values for key, values in plain.items()}


def _own(facts: DataFrame) -> list[str]:
    return [c for c in facts.columns if c.startswith("cfg_")]


def _is_one(low: Column, names: Names) -> Column:
    if isinstance(names, list):
        return low.isin([n.lower() for n in names])
    return F.exists(names, lambda n: F.lower(n) == low)


def _has_one(low: Column, words: Names) -> Column:
    if isinstance(words, list):
        return S.contains_any(low, [w.lower() for w in words])
    return F.exists(words, lambda w: F.contains(low, F.lower(w)))


def is_auth_guard(name: Column, names: Names) -> Column:
    low = F.lower(name)
    return _is_one(low, names) | S.contains_any(low, V.AUTH_GUARD_WORDS)


def is_limiter(name: Column, names: Names) -> Column:
    return _is_one(F.lower(name), names)


def is_sensitive(route: Column, method: Column, keywords: Names) -> Column:
    low = F.lower(route)
    return _has_one(low, keywords) | (method.isin(V.MUTATING_METHODS) & low.rlike(r"(^|/)api(/|$)"))


def project_flags(facts: DataFrame, checks: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per repository: what any of its files, routes or global guards shows.

    Booleans are formed per file, so the exchange carries a few bytes per task
    and repository.
    """
    cfg = _lists(facts, checks)
    auth, limit = cfg["authMiddlewareNames"], cfg["rateLimitMiddlewareNames"]
    limited = F.exists("use_guards", lambda g: is_limiter(g, limit)) | F.exists(
        "routes", lambda r: F.exists(r["guards"], lambda g: is_limiter(g, limit))
    )
    routed = F.size("routes") > 0
    return facts.groupBy("repo").agg(
        F.bool_or(F.col("helmet") | F.array_contains("use_guards", "helmet")).alias("helmet"),
        F.bool_or("csp").alias("csp"),
        F.bool_or("hsts").alias("hsts"),
        F.bool_or(F.col("rate_limit") | limited).alias("rate_limit"),
        F.bool_or(F.col("web_import") | routed).alias("web_app"),
        F.bool_or(F.exists("use_guards", lambda g: is_auth_guard(g, auth))).alias("global_auth"),
        F.min(F.when(routed, F.col("file"))).alias("first_route_file"),
    )


def default_checks() -> dict[str, list[str]]:
    return {key: values for (scope, key), values in V.DEFAULT_CONFIG.items() if scope == "checkers"}


def missing_auth(facts: DataFrame, checks: dict[str, list[str]] | None = None) -> DataFrame:
    """Sensitive routes without an auth guard, unless one covers the whole repository."""
    cfg = _lists(facts, checks)
    names = cfg["authMiddlewareNames"]
    open_routes = routes(facts).filter(
        is_sensitive(F.col("route"), F.col("method"), cfg["sensitivePathKeywords"])
        & ~F.exists("guards", lambda g: is_auth_guard(g, names))
    )
    covered = facts.filter(F.exists("use_guards", lambda g: is_auth_guard(g, names))).select("repo").distinct()
    left = salted_join(open_routes, covered, ["repo"], ["file", "line"], "left_anti")
    return make_findings(
        left,
        repo="repo",
        tool=F.lit(V.CHECK_AUTH),
        rule_id=F.lit(V.RULE_PREFIX + "missing-auth"),
        severity=F.lit("high"),
        category=F.lit("missing-auth"),
        confidence=F.lit("medium"),
        file="file",
        line="line",
        message=F.concat(
            F.lit("Sensitive route "), F.col("method"), F.lit(" "), F.col("route"),
            F.lit(" shows no authentication or authorization guard."),
        ),
        ai_relevant=F.lit(True),
        remediation=F.lit("Guard the route or the whole app with an auth middleware or decorator; list routes that are public on purpose in the ignore list."),
        references=F.array(F.lit("https://owasp.org/Top10/A01_2021-Broken_Access_Control/")),
    )


def missing_rate_limit(facts: DataFrame, checks: dict[str, list[str]] | None = None) -> DataFrame:
    """Login-like routes of repositories in which no limiter appears anywhere."""
    cfg = _lists(facts, checks)
    hit = routes(facts).filter(
        _has_one(F.lower("route"), cfg["sensitiveRoutePatterns"])
    )
    limited = project_flags(facts, checks).filter("rate_limit").select("repo")
    left = salted_join(hit, limited, ["repo"], ["file", "line"], "left_anti")
    return make_findings(
        left,
        repo="repo",
        tool=F.lit(V.CHECK_RATE_LIMIT),
        rule_id=F.lit(V.RULE_PREFIX + "missing-rate-limit"),
        severity=F.lit("medium"),
        category=F.lit("missing-rate-limit"),
        confidence=F.lit("medium"),
        file="file",
        line="line",
        message=F.concat(
            F.lit("Login-like route "), F.col("method"), F.lit(" "), F.col("route"),
            F.lit(" is not rate limited and the app has no limiter, so credentials can be guessed."),
        ),
        ai_relevant=F.lit(True),
        remediation=F.lit("Put a rate limiter in front of login-like routes or of the whole app."),
        references=F.array(F.lit("https://owasp.org/www-community/controls/Blocking_Brute_Force_Attacks")),
    )


def missing_headers(facts: DataFrame) -> DataFrame:
    """One finding per web app without a headers library and without both key headers."""
    flags = project_flags(facts).filter(
        F.col("web_app") & ~F.col("helmet") & ~(F.col("csp") & F.col("hsts"))
    )
    missing = F.array_join(
        F.array_compact(
            F.array(
                F.when(~F.col("csp"), F.lit("Content-Security-Policy")),
                F.when(~F.col("hsts"), F.lit("Strict-Transport-Security")),
            )
        ),
        ", ",
    )
    return make_findings(
        flags,
        repo="repo",
        tool=F.lit(V.CHECK_HEADERS),
        rule_id=F.lit(V.RULE_PREFIX + "missing-security-headers"),
        severity=F.lit("medium"),
        category=F.lit("missing-security-headers"),
        confidence=F.lit("medium"),
        file="first_route_file",
        message=F.concat(F.lit("The web app sets no security headers; missing: "), missing, F.lit(".")),
        ai_relevant=F.lit(True),
        remediation=F.lit("Add helmet, flask-talisman or the like and set both headers; ignore this if a proxy sets them."),
        references=F.array(F.lit("https://owasp.org/www-project-secure-headers/")),
    )


def check_findings(files: DataFrame, checks: dict[str, list[str]] | None = None, config: DataFrame | None = None) -> DataFrame:
    """Findings of the three route checks; the files are read once.

    ``config`` (from ``overlay_config``) gives repositories lists of their own.
    """
    facts = durable(route_facts(files))
    if config is not None:
        facts = durable(with_lists(facts, config))
    return concat_findings(missing_auth(facts, checks), missing_rate_limit(facts, checks), missing_headers(facts))
