"""Registered queries (Spark side) and their DuckDB oracle text.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the whole given
tables.  Float outputs are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.models.nb import GaussianNB
from lacuna.operators import metrics as M
from lacuna.operators.ranking import topk_long
from lacuna.operators.sample import rare_class_filter, split_guaranteed
from lacuna.plans import oracle as O
from lacuna.session import cut_lineage
from lacuna.sources.fixtures import POLICY_SPEC, POLICY_SQL, policy, with_sql

from lacuna.plans.registry import QUERIES, SQL, query, r6  # noqa: F401


# ---------------------------------------------------------------- minimum slice

def policy_split(spark: SparkSession, sf: str, seed: int = 42) -> DataFrame:
    """policy -> rare-class filter (>= 3) -> guaranteed split .7/.1/.2,
    materialised once (several passes read it)."""
    p = rare_class_filter(policy(spark, sf), "product_item", 3)
    return cut_lineage(split_guaranteed(p, POLICY_SPEC, 0.7, 0.1, seed))


def _nb_test(spark, sf):
    s = policy_split(spark, sf)
    train = s.where(F.col("split") == "train")
    test = s.where(F.col("split") == "test")
    model = GaussianNB(POLICY_SPEC, k=3).fit(train)
    return model.proba(test)


_SPLIT_BASE = [POLICY_SQL, O.rare_filter_sql("policy"), O.split_sql("filt")]
_NB_BASE = _SPLIT_BASE + [O.zscore_sql("split", POLICY_SPEC), O.nb_proba_sql("z", POLICY_SPEC)]


@query("policy_topk_nb_hr_ndcg", with_sql(*_NB_BASE, O.topk_sql("nbp")) + """
, hit AS (SELECT row_id, min(CASE WHEN cid = y AND rnk <= 3 THEN rnk END) AS r FROM rk GROUP BY row_id)
SELECT count(*) AS n_test,
       round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hr_k,
       round(avg(coalesce(1.0 / log2(r + 1), 0.0)), 6) AS ndcg_k
FROM hit""")
def q_entry(spark, sf):
    p = _nb_test(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("n_test"),
                 *[r6(c).alias(n) for c, n in zip(M.rank_metrics(p, 3, which=("hr_k", "ndcg_k")),
                                                  ("hr_k", "ndcg_k"))])


@query("topk_items", with_sql(*_NB_BASE, O.topk_sql("nbp")) + """
SELECT row_id, CAST(rnk AS BIGINT) AS rank, cid AS class_id, round(p, 6) AS proba FROM rk WHERE rnk <= 3""")
def q_topk(spark, sf):
    t = topk_long(_nb_test(spark, sf), 3)
    return t.select("row_id", "rank", "class_id", r6(F.col("proba")).alias("proba"))


@query("split_guaranteed", with_sql(*_SPLIT_BASE) + """
SELECT row_id, product_item, split FROM split""")
def q_split(spark, sf):
    return policy_split(spark, sf).select("row_id", "product_item", "split")


@query("split_class_counts", with_sql(*_SPLIT_BASE) + """
SELECT split, product_item, count(*) AS n FROM split GROUP BY split, product_item""")
def q_split_counts(spark, sf):
    return policy_split(spark, sf).groupBy("split", "product_item").agg(F.count(F.lit(1)).alias("n"))


# the other query groups register themselves on import
from lacuna.plans import q_clean, q_prep, q_rank, q_models, q_embed  # noqa: E402,F401
