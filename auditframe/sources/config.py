"""Configuration and baseline sources. ``config(repo, scope, key, value array<string>)``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe import vocabulary as V


def _default_entries():
    return F.array(
        *[
            F.struct(
                F.lit(scope).alias("scope"),
                F.lit(key).alias("key"),
                F.array(*[F.lit(v) for v in values]).cast("array<string>").alias("value"),
            )
            for (scope, key), values in V.DEFAULT_CONFIG.items()
        ]
    )


def valid_settings(user: DataFrame) -> DataFrame:
    """Drop a ``failOn`` that names no severity; everything else passes."""
    bad = (
        (F.col("scope") == "")
        & (F.col("key") == "failOn")
        & ~F.coalesce(F.lower(F.get("value", F.lit(0))).isin(V.SEVERITIES), F.lit(False))
    )
    return user.filter(~bad)


def overlay_config(user: DataFrame, repos: DataFrame) -> DataFrame:
    """Defaults for every repository, replaced key by key by what its user set.

    Defaults and user rows share one grouping instead of an outer join: the
    defaults are a fixed list per repository, and ``max_by`` prefers user rows.
    """
    entries = repos.select("repo").distinct().select("repo", F.inline(_default_entries()))
    layers = entries.select("repo", "scope", "key", "value", F.lit(0).alias("layer")).unionByName(
        valid_settings(user).select("repo", "scope", "key", "value", F.lit(1).alias("layer"))
    )
    return layers.groupBy("repo", "scope", "key").agg(
        F.max_by("value", "layer").alias("value"), (F.max("layer") == 1).alias("overridden")
    )


def repo_settings(config: DataFrame) -> DataFrame:
    """(repo, fail_on, data_files) from an overlaid configuration."""

    def single(scope: str, key: str):
        hit = (F.col("scope") == scope) & (F.col("key") == key)
        return F.max(F.when(hit, F.lower(F.get("value", F.lit(0)))))

    return config.groupBy("repo").agg(
        single("", "failOn").alias("fail_on"), single("secrets", "dataFiles").alias("data_files")
    )


def repo_lists(config: DataFrame, scope: str) -> DataFrame:
    """(repo, cfg_<key> array<string>, ...): the lists of a scope that users set; null where a repository keeps the default."""
    keys = [key for (s, key) in V.DEFAULT_CONFIG if s == scope]
    own = config.filter((F.col("scope") == scope) & F.col("key").isin(keys) & F.col("overridden"))
    return own.groupBy("repo").agg(*[F.max_by(F.when(F.col("key") == key, F.col("value")), F.col("key") == key).alias(f"cfg_{key}") for key in keys])


def with_config_ignores(ignore_lines: DataFrame, config: DataFrame) -> DataFrame:
    """Ignore lists with the configuration's own ``ignore`` lines behind those of the file."""
    own = config.filter((F.col("scope") == "") & (F.col("key") == "ignore"))
    lines = own.select("repo", F.posexplode("value").alias("pos", "line"))
    behind = lines.select("repo", (F.lit(1 << 30) + F.col("pos")).cast("int").alias("ord"), "line")
    return ignore_lines.select("repo", "ord", "line").unionByName(behind)


def unknown_keys(user: DataFrame) -> DataFrame:
    """Settings nobody reads, most likely typos."""
    known = F.lit(False)
    for scope, keys in V.KNOWN_CONFIG_KEYS.items():
        known = known | ((F.col("scope") == scope) & F.col("key").isin(keys))
    return user.filter(~known & F.col("scope").isin(list(V.KNOWN_CONFIG_KEYS))).select("repo", "scope", "key")


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """Baseline table, or None when there is none (then every finding is new)."""
    try:
        return spark.read.parquet(path).select("repo", "fingerprint")
    except AnalysisException:
        return None
