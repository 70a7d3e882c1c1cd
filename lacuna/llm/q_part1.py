"""Queries of exact dedup, quality and chat formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.llm import chat_format, exact_dedup, quality
from lacuna.llm.registry import documents, query


@query("op1_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op1(spark, sf_dir):
    """Exact dedup of ``documents``, its older half taken as the history."""
    out = exact_dedup.dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


@query("op2_quality")
def op2(spark, sf_dir):
    """Quality score of every document by boosted trees."""
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


_ESC = r"length({c}) * 2 - length(replace(replace(replace({c}, '\', ''), '<', ''), '[', ''))"


@query("op9_chat_format", rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_ESC.format(c='role')} + {_ESC.format(c='text')}
            + CASE WHEN role = 'assistant' THEN 13 ELSE 16 END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def op9(spark, sf_dir):
    """All conversations, and one whose texts hold control strings."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    turn = lambda n, role: F.struct(F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), said)
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"),
                                F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_format.digests(rows.unionByName(own))
