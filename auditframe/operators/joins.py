"""Equi joins that keep working when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
_SALT = "__salt"
#: Salt of a finding that follows from its issue: joins per repository or file and the merge behind them share one exchange.
SPREAD = "__spread"
#: Task that holds rows laid out by :func:`by_spread`.
TASK = "__task"
#: Tasks among which one file's findings are spread, and among how many times as many those of a repository.
SPREADS = 8
FILE_SPREADS = 2


def spread_of(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SPREADS)).cast("int")


def in_file(spread: Column, file: str | Column = "file") -> Column:
    """The ``SPREAD`` of a file's findings whose place in it has this ``spread_of``."""
    return spread * FILE_SPREADS + F.pmod(F.xxhash64(file), F.lit(FILE_SPREADS)).cast("int")


def by_spread(df: DataFrame) -> DataFrame:
    """Lay rows out by repository and ``SPREAD``, adding the ``TASK`` that has them.

    Sides laid out so are joined where they lie on ``TASK`` and whatever else, and so are rows grouped. A repository's
    spreads go to tasks of their own.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.pmod(F.pmod(F.xxhash64("repo"), F.lit(n)) + F.col(SPREAD), F.lit(n)).cast("int")
    return df.withColumn(TASK, task).repartitionById(n, TASK)


def for_all_spreads(df: DataFrame) -> DataFrame:
    """A copy of each repository's row for every ``SPREAD``, laid out by it."""
    return by_spread(df.withColumn(SPREAD, F.explode(F.array(*[F.lit(i) for i in range(SPREADS * FILE_SPREADS)]))))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[str | Column],
    how: str = "left",
    salts: int = SALTS,
    tasks: int | None = None,
) -> DataFrame:
    """Join ``left`` with a much smaller ``right``, spreading every key over ``salts`` tasks.

    ``right`` is repeated once per salt. The salt of a left row is a hash of its
    ``spread`` columns, so a retried task gives every row the same salt again.
    If ``right`` turns out small, adaptive execution broadcasts it instead.
    With ``tasks`` the joined rows are that many tasks' work, however few bytes they have.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    salted_right = right.withColumn(_SALT, copies)
    salted_left = left.withColumn(_SALT, salt)
    if tasks is not None:
        salted_left = salted_left.repartition(tasks, *on, _SALT)
    return salted_left.join(salted_right, [*on, _SALT], how).drop(_SALT)
