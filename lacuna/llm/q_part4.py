"""Queries of decontamination, the dataset manifest and ranked search."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from lacuna.llm import decontaminate, lexical_search, merkle
from lacuna.llm.registry import documents, query


def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


_LOW = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op12_decontaminate", rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS run
        FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM b)),
lens AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS run
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN win USING (l, run)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op12(spark, sf_dir):
    """Words of all documents inside windows of test items."""
    found = decontaminate.contamination(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), decontaminate.n_covered(F.col("spans")).alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


@query("op11_merkle_manifest")
def op11(spark, sf_dir):
    """All documents in one manifest; one in seven claims another length."""
    m = merkle.build(merkle.document_leaves(documents(spark, sf_dir)))
    return merkle.prove(m, m.rows).withColumnRenamed("proof", "proof_sha256")


_TERMS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op13_lexical_search", rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n),
m AS (SELECT doc_id, 75 + (25 * len(t) * n) // l AS m FROM d, c WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER r AS INT) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20""")
def op13(spark, sf_dir):
    """The 20 best documents of every test item."""
    return lexical_search.search(documents(spark, sf_dir), benchmark(spark, sf_dir), k=20)
