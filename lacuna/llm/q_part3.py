"""Queries of nearest neighbours, near copies and repeated substrings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.llm import near_dedup, substring_dedup, vector_search
from lacuna.llm.registry import documents, query


@query("op6_vector_search")
def op6(spark, sf_dir):
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return vector_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


@query("op4_near_dedup")
def op4(spark, sf_dir):
    """Near copies among all documents: 4-word shingles, similarity 0.8."""
    return near_dedup.near_dedup(documents(spark, sf_dir), words=4, percent=80)


@query("op7_substring_dedup")
def op7(spark, sf_dir):
    """Words of windows that an earlier document has."""
    return substring_dedup.substring_dedup(documents(spark, sf_dir)).drop("kept")
