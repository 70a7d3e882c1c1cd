"""Corpus preparation in five stages: quality filter, exact dedup, near dedup,
secret redaction, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its
predecessor kept; all but the last give the columns of ``documents``.  Between
stages the rows are written as Parquet to the shared folder and read again, so
that a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import exact_dedup, near_dedup, packing, quality, secrets
from lacuna.session import stage

#: Score under which the quality stage rejects a document.
QUALITY_THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, QUALITY_THRESHOLD)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return exact_dedup.kept_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies (5-word shingles,
    similarity 0.8)."""
    return near_dedup.kept_rows(docs, words=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind in brackets."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage),
          ("secrets", secrets_stage), ("packing", packing_stage)]

#: SQL expresses neither the classifier nor the similarity join; the pipeline
#: is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
