"""What several operators of the subpackage need."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from auditframe.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH = "spark.auditframe.scratch"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all tables that operators store inside; it is deleted at the end, also after a failure.

    Results read those tables, so write them out before the block ends.
    """
    before = spark.conf.get(_SCRATCH, None)
    folder = f"{before or shared_dir(spark)}/run-{uuid.uuid4().hex}"
    spark.conf.set(_SCRATCH, folder)
    try:
        yield folder
    finally:
        if before:
            spark.conf.set(_SCRATCH, before)
        else:
            spark.conf.unset(_SCRATCH)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the folder all executors share and read it back.

    Cuts the lineage: what follows reads files, so a lost executor costs the tasks it
    ran and nothing before them. The folder is scratch space of the job, or of the ``scratch`` block it is in.
    """
    folder = df.sparkSession.conf.get(_SCRATCH, None) or shared_dir(df.sparkSession)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that do not clash with any column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate, n = f"__{name}", 0
        while candidate.lower() in taken:
            n += 1
            candidate = f"__{name}{n}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out
