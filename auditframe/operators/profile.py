"""Repository profiles from file listings: stacks, languages, tools, constraints.

``listing(repo, path, content)``. Stacks are booleans per file, reduced per
repository with partial aggregates; marker lists stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import vocabulary as V
from auditframe.functions import scalars as S
from auditframe.sources.files import listed

# File names that mark a stack.
PYTHON_FILES = ["requirements.txt", "Pipfile", "pyproject.toml", "setup.py", "setup.cfg"]
COMPOSE_FILES = ["docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]
JAVA_FILES = ["pom.xml", "build.gradle", "build.gradle.kts"]
DOTNET_EXTENSIONS = [".csproj", ".vbproj", ".fsproj", ".sln"]

# Which scanners a stack calls for.
STACK_TOOLS = {
    "node": ["npm-audit", "eslint"],
    "python": ["pip-audit", "bandit"],
    "docker": ["trivy"],
    "terraform": ["trivy"],
    "kubernetes": ["trivy"],
    "git": ["gitleaks", "trufflehog"],
}
STACKS = ["node", "python", "docker", "terraform", "kubernetes", "java", "dotnet", "git"]


def is_k8s_manifest(path: str | Column = "path", content: str | Column = "content") -> Column:
    """YAML with top-level ``kind`` and ``apiVersion``; the whole text is looked at."""
    base, ext, text = S.basename(path), S.extension(path), S.col_of(content)
    return F.coalesce(
        ext.isin(".yaml", ".yml")
        & ~base.isin(COMPOSE_FILES)
        & text.rlike(r"(?m)^\s*kind:\s*\S+")
        & text.rlike(r"(?m)^\s*apiVersion:\s*\S+"),
        F.lit(False),
    )


def stack_flags() -> dict[str, Column]:
    """Per file: does it mark the stack."""
    base, ext = S.basename("path"), S.extension("path")
    dockerfile = (base == "Dockerfile") | base.startswith("Dockerfile.") | base.endswith(".Dockerfile")
    return {
        "node": base == "package.json",
        "python": base.isin(PYTHON_FILES) | (ext == ".py"),
        "docker": dockerfile | base.isin(COMPOSE_FILES),
        "terraform": ext.isin(".tf", ".tfvars"),
        "kubernetes": is_k8s_manifest(),
        "java": base.isin(JAVA_FILES),
        "dotnet": ext.isin(DOTNET_EXTENSIONS),
    }


def _visible(listing: DataFrame, max_depth: int | None) -> DataFrame:
    """Listed files; ``.git`` entries stay because they mark version control."""
    return listing.filter(listed(max_depth=max_depth) | _is_git())


def _is_git() -> Column:
    return (F.col("path") == ".git") | F.startswith(F.col("path"), F.lit(".git/"))


def repo_profile(listing: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row per repository: eight stack booleans, languages, enabled tools, source flag, file count.

    Files at any depth count unless ``max_depth`` says otherwise.
    """
    seen, git = listed(max_depth=max_depth), _is_git()
    ext = S.extension("path")
    rows = _visible(listing, max_depth)
    flags = {name: F.bool_or(seen & cond) for name, cond in stack_flags().items()}
    flags["git"] = F.bool_or(git)
    profile = rows.groupBy("repo").agg(
        *[flags[s].alias(s) for s in STACKS],
        F.bool_or(seen & ext.isin(V.SOURCE_EXTENSIONS)).alias("has_source"),
        F.bool_or(seen & ext.isin(V.JS_STACK_EXTENSIONS)).alias("has_js"),
        F.count_if(seen).alias("files"),
    )
    languages = F.array_compact(
        F.array(
            F.when(F.col("node") | F.col("has_js"), F.lit("javascript")),
            F.when(F.col("python"), F.lit("python")),
        )
    )
    tools = [F.when(F.col(stack), F.lit(tool)) for stack, names in STACK_TOOLS.items() for tool in names]
    tools.append(F.when(F.col("has_source"), F.lit("semgrep")))
    return profile.select(
        "repo", *STACKS, "has_source", "files",
        languages.alias("languages"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*tools)))).alias("enabled_tools"),
    )


def repo_markers(listing: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distinct (repo, stack, marker): files, or a folder pattern for Python and Terraform sources."""
    flags = stack_flags()
    ext, base = S.extension("path"), S.basename("path")
    folder = F.concat(F.lit(" ("), S.dirname("path"), F.lit(")"))
    path = F.col("path")
    named = {
        **{s: (flags[s], path) for s in ("node", "docker", "kubernetes", "java", "dotnet")},
        "python": (base.isin(PYTHON_FILES), path),
        "terraform": (flags["terraform"], F.concat(F.lit("*.tf"), folder)),
    }
    entries = [F.when(cond, F.struct(F.lit(s).alias("stack"), m.alias("marker"))) for s, (cond, m) in named.items()]
    entries.append(
        F.when(ext == ".py", F.struct(F.lit("python").alias("stack"), F.concat(F.lit("*.py"), folder).alias("marker")))
    )
    seen = listing.filter(listed(max_depth=max_depth))
    rows = seen.select("repo", F.inline(F.array_compact(F.array(*entries))))
    git = listing.filter(_is_git()).select("repo", F.lit("git").alias("stack"), F.lit(".git").alias("marker"))
    return rows.unionByName(git).distinct()


def node_constraint(listing: DataFrame) -> DataFrame:
    """(repo, source, value): the Node version a repository asks for, first of three places."""
    root = listing.filter(F.col("path").isin(".nvmrc", ".node-version", "package.json"))
    first_line = S.nonempty(S.strip(F.substring_index(S.strip("content"), "\n", 1)))
    engine = S.nonempty(F.get_json_object("content", "$.engines.node"))
    value = F.when(F.col("path") == "package.json", engine).otherwise(first_line)
    rank = S.lookup(F.col("path"), {".nvmrc": 0, ".node-version": 1, "package.json": 2})
    rows = root.select("repo", rank.alias("rank"), value.alias("value")).filter(F.col("value").isNotNull())
    best = rows.groupBy("repo").agg(F.min(F.struct("rank", "value")).alias("b"))
    names = {0: ".nvmrc", 1: ".node-version", 2: "package.json engines.node"}
    return best.select("repo", S.lookup(F.col("b.rank"), names).alias("source"), F.col("b.value").alias("value"))


def applicable_checks(profile: DataFrame) -> DataFrame:
    """(repo, check): our own checks for repositories with a language they read."""
    web = F.size("languages") > 0
    return profile.filter(web).select("repo", F.explode(F.array(*[F.lit(c) for c in V.CHECKS])).alias("check"))
