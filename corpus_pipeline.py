"""From raw documents to packed training sequences, in five stages.

Every stage but the last returns the columns of ``documents``. Each is written as Parquet in the folder all
executors share and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import decontaminate, line_dedup, near_dup, packing, quality
from auditframe.llm.common import stored, table
from auditframe.llm.queries import word_vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; the count of characters follows, a document without lines stays as an empty one."""
    kept = line_dedup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, judged by shingles of two words as in ``op5``."""
    return near_dup.drop_near_duplicates(docs, shingle=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in the sequences."""
    return packing.pack_documents(docs, word_vocabulary()).drop("ids")


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminated),
    ("best_fit_packing", pack),
]

#: SQL cannot express the classifier, the signatures or the vocabulary; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
