"""Queries of toxicity, secrets, packing and byte-level BPE."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.llm import byte_bpe, packing, secrets, toxicity
from lacuna.llm.registry import documents, query


@query("op3_toxicity")
def op3(spark, sf_dir):
    """Expected severity of every document."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", "severity", F.col("p_toxic").alias("score"),
                                              (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))


@query("op5_secrets")
def op5(spark, sf_dir):
    """All secret spans of every document."""
    s = secrets.scan(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    return s.select("doc_id", *[n(k) for k in secrets.BASE],
                    F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"),
                    F.array_join(F.transform("spans", line), ",").alias("spans"))


@query("op8_packing")
def op8(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers
    p = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                    "offset", "tier", "step_id")


@query("op10_byte_bpe")
def op10(spark, sf_dir):
    """Byte-level BPE of every document, there and back."""
    import public_tokenizers
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
