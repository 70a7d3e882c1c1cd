"""Probability tables, top-k, metrics (Q-01..Q-10, U-05) on naive-Bayes
probabilities of the policy test split, and result analytics (A-06..A-09)
over a stand-in experiment log built from orders x customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import analytics as A
from lacuna.operators import metrics as M
from lacuna.operators.ranking import proba_long, proba_wide, recommend_wide
from lacuna.plans import oracle as O
from lacuna.plans.catalog import _NB_BASE, _nb_test
from lacuna.plans.registry import query, r6
from lacuna.sources.fixtures import with_sql
from lacuna.sources.tables import read_table

NB = with_sql(*_NB_BASE)
NBK = with_sql(*_NB_BASE, O.topk_sql("nbp"))
HIT = """, hit AS (SELECT row_id, min(CASE WHEN cid = y AND rnk <= 3 THEN rnk END) AS r FROM rk GROUP BY row_id)"""


@query("proba_long_wide", NB + """
SELECT row_id, cid AS class_id, round(p, 6) AS proba FROM nbp""")
def q_proba_long(spark, sf):
    """Q-01: wide array -> long rows -> wide array -> long rows (round trip)."""
    p = _nb_test(spark, sf)
    w = proba_wide(proba_long(p), 15)
    return proba_long(w).select("row_id", "class_id", r6(F.col("proba")).alias("proba"))


@query("recommend_wide", NBK + """
SELECT row_id, max(CASE WHEN rnk = 1 THEN cid END) AS top1, max(CASE WHEN rnk = 2 THEN cid END) AS top2,
       max(CASE WHEN rnk = 3 THEN cid END) AS top3 FROM rk GROUP BY row_id""")
def q_recommend_wide(spark, sf):
    """Q-03: items only, top1..top3."""
    return recommend_wide(_nb_test(spark, sf), 3)


def _one(metric: str, sql_expr: str):
    @query(metric, NBK + HIT + f"\nSELECT round({sql_expr}, 6) AS {metric} FROM hit")
    def _q(spark, sf):
        p = _nb_test(spark, sf)
        (e,) = M.rank_metrics(p, 3, which=(metric,))
        return p.agg(r6(e).alias(metric))
    return _q


_one("mrr_k", "avg(coalesce(1.0 / r, 0.0))")
_one("recall_k", "avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END)")
_one("hr_k", "avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END)")
_one("ndcg_k", "avg(coalesce(1.0 / log2(r + 1), 0.0))")


@query("auc_ovr", with_sql(*_NB_BASE, O.auc_sql("nbp")) + """
SELECT class_id, round(auc, 6) AS auc FROM aucc""")
def q_auc(spark, sf):
    """Q-08 per class (the macro mean is in score_all)."""
    return M.auc_per_class(_nb_test(spark, sf)).select("class_id", r6(F.col("auc")).alias("auc"))


LOGLOSS_SQL = f"-avg(ln(greatest(least(p, 1.0 - CAST({M.EPS!r} AS DOUBLE)), CAST({M.EPS!r} AS DOUBLE))))"


@query("logloss", NB + f"""
SELECT round({LOGLOSS_SQL}, 6) AS logloss FROM nbp WHERE cid = y""")
def q_logloss(spark, sf):
    """Q-09."""
    return _nb_test(spark, sf).agg(r6(M.logloss_expr()).alias("logloss"))


@query("score_all", with_sql(*_NB_BASE, O.topk_sql("nbp"), O.auc_sql("nbp")) + HIT + f"""
, ll AS (SELECT {LOGLOSS_SQL} AS v FROM nbp WHERE cid = y),
hk AS (SELECT avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END) AS hr, avg(coalesce(1.0 / log2(r + 1), 0.0)) AS nd
       FROM hit)
SELECT 0 AS ord, 'auc' AS metric, round((SELECT avg(auc) FROM aucc), 6) AS score
UNION ALL SELECT 1, 'logloss', round((SELECT v FROM ll), 6)
UNION ALL SELECT 2, 'hr_k', round((SELECT hr FROM hk), 6)
UNION ALL SELECT 3, 'ndcg_k', round((SELECT nd FROM hk), 6)""")
def q_score_all(spark, sf):
    """Q-10: metrics in the requested order, one pass each (probabilities
    computed once)."""
    from lacuna.session import cut_lineage
    p = cut_lineage(_nb_test(spark, sf))
    s = M.score_all(p, 3, ("auc", "logloss", "hr_k", "ndcg_k"))
    return s.select(F.col("ord").cast("int").alias("ord"), "metric", r6(F.col("score")).alias("score"))


@query("truth_join", NB + """
, pred AS (SELECT row_id, arg_max(cid, p) AS pred FROM nbp GROUP BY row_id)
SELECT t.row_id, t.y AS truth, pred.pred FROM (SELECT DISTINCT row_id, y FROM nbp) t JOIN pred USING (row_id)""")
def q_truth_join(spark, sf):
    """U-05: truth and prediction held apart, aligned by an equi-join on
    row_id (never by position)."""
    p = _nb_test(spark, sf)
    pred = p.select("row_id", F.array_position(F.col("proba"), F.array_max("proba")).alias("_pos"))
    pred = pred.select("row_id", (F.col("_pos") - 1).cast("long").alias("pred"))
    truth = p.select("row_id", F.col("product_item").alias("truth"))
    return truth.join(pred, "row_id")


# ---------------------------------------------------------------- A-06..A-09

LOG_SQL = """
WITH log AS (
  SELECT o.o_orderstatus AS dataset, o.o_orderpriority AS model, c.c_mktsegment AS metric,
         o.o_totalprice AS score, CAST(year(o.o_orderdate) AS INTEGER) AS factor, c.c_acctbal AS time_sec
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def stand_in_log(spark, sf):
    o = read_table(spark, sf, "orders", ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
                                         "o_orderdate"])
    c = read_table(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"),
        F.col("c_mktsegment").alias("metric"), F.col("o_totalprice").alias("score"),
        F.year("o_orderdate").cast("int").alias("factor"), F.col("c_acctbal").alias("time_sec"))


MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("pivot_mean", LOG_SQL + "\nSELECT factor, " + ", ".join(
    f'round(avg(CASE WHEN model = \'{m}\' THEN score END), 4) AS "{m}"' for m in MODELS) + " FROM log GROUP BY factor")
def q_pivot_mean(spark, sf):
    """A-06: group mean -> pivot grid (factor x model)."""
    g = A.pivot_mean(stand_in_log(spark, sf), "factor", "model", "score", MODELS)
    return g.select("factor", *[F.round(F.col(f"`{m}`"), 4).alias(m) for m in MODELS])


@query("mean_se", LOG_SQL + """
SELECT factor, model, round(avg(score), 4) AS mean, round(stddev_samp(score) / sqrt(count(*)), 4) AS se
FROM log WHERE factor BETWEEN 1993 AND 1997 GROUP BY factor, model""")
def q_mean_se(spark, sf):
    """A-07: mean +- standard error by (factor, model) for selected factors."""
    g = A.mean_se(stand_in_log(spark, sf).where(F.col("factor").between(1993, 1997)), ["factor", "model"], "score")
    return g.select("factor", "model", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"))


@query("factor_means", LOG_SQL + """
SELECT factor, round(avg(score), 4) AS score, round(avg(time_sec), 4) AS time_sec FROM log GROUP BY factor""")
def q_factor_means(spark, sf):
    """A-08: mean score and mean time per factor."""
    g = A.factor_means(stand_in_log(spark, sf), "factor", ["score", "time_sec"])
    return g.select("factor", F.round("score", 4).alias("score"), F.round("time_sec", 4).alias("time_sec"))


@query("welch_t", LOG_SQL + """
, st AS (SELECT dataset, metric, model, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM log
         GROUP BY dataset, metric, model)
SELECT a.dataset, a.metric, b.model AS baseline, round(a.m, 6) AS target_mean, round(b.m, 6) AS baseline_mean,
       CASE WHEN a.n > 1 AND b.n > 1 AND (a.v > 0 OR b.v > 0)
            THEN round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) END AS t,
       CASE WHEN a.n > 1 AND b.n > 1 AND (a.v > 0 OR b.v > 0) THEN round(power(a.v / a.n + b.v / b.n, 2)
            / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 4) END AS df,
       CASE WHEN a.metric = 'logloss' THEN a.m < b.m ELSE a.m > b.m END AS improved
FROM st a JOIN st b ON a.dataset = b.dataset AND a.metric = b.metric AND a.model = '1-URGENT' AND b.model <> '1-URGENT'
""")
def q_welch_t(spark, sf):
    """A-09: Welch t statistic and degrees of freedom, target vs each
    baseline per (dataset, metric); p-values: ``welch_p``."""
    w = A.welch(stand_in_log(spark, sf), "1-URGENT", ["dataset", "metric"], "model", "score", with_p=False)
    return w.select("dataset", "metric", "baseline", r6(F.col("target_mean")).alias("target_mean"),
                    r6(F.col("baseline_mean")).alias("baseline_mean"), r6(F.col("t")).alias("t"),
                    F.round("df", 4).alias("df"), "improved")


@query("welch_p")
def q_welch_p(spark, sf):
    """A-09: two-sided p-value (regularised incomplete beta) and the p<0.01
    significance flag."""
    w = A.welch(stand_in_log(spark, sf), "1-URGENT", ["dataset", "metric"], "model", "score", with_p=True)
    return w.select("dataset", "metric", "baseline", r6(F.col("p_value")).alias("p_value"), "significant",
                    "improved")


@query("result_sink_roundtrip", LOG_SQL + """
SELECT dataset AS experiment, model, metric, round(avg(score), 6) AS score FROM log GROUP BY dataset, model, metric""")
def q_result_sink(spark, sf):
    """S-06/S-07: per-experiment results written partitioned by experiment
    (written twice: the second write replaces, never duplicates), read back."""
    import uuid
    from lacuna.session import shared_folder
    from lacuna.sources.io import read_results, write_results
    res = (stand_in_log(spark, sf).groupBy(F.col("dataset").alias("experiment"), "model", "metric")
           .agg(r6(F.avg("score")).alias("score")))
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    write_results(res, path)
    write_results(res, path)
    return read_results(spark, path).select("experiment", "model", "metric", "score")
