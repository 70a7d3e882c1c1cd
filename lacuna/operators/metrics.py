"""Q-04..Q-10: ranking and probability metrics as aggregations.

Every metric is an ``avg`` over rows or a per-class aggregation; truth and
prediction are aligned by being columns of the same row (U-05: an equi-join
on ``row_id`` when they come apart).  Exact OvR AUC avoids a per-class
global sort: distinct scores are bucketed by value (monotone), bucket
totals give the negatives below each bucket, and only inside a
(class, bucket) group are scores ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.ranking import topk_array

EPS = 2.220446049250313e-16  # float64 machine epsilon: the log-loss clip


def true_rank(proba: Column, label: Column, k: int) -> Column:
    """1-based rank of the true class within the top-k, else NULL."""
    t = topk_array(proba, k)
    pos = F.array_position(F.transform(t, lambda s: s["class_id"]), label.cast("long"))
    return F.when(pos > 0, pos)


def rank_metrics(df: DataFrame, k: int, label: str = "product_item", proba: str = "proba",
                 which=("mrr_k", "recall_k", "hr_k", "ndcg_k")) -> list[Column]:
    r = true_rank(F.col(proba), F.col(label), k)
    exprs = {
        "mrr_k": F.avg(F.coalesce(F.lit(1.0) / r, F.lit(0.0))),
        "recall_k": F.avg(r.isNotNull().cast("double")),
        "hr_k": F.avg(r.isNotNull().cast("double")),
        "ndcg_k": F.avg(F.coalesce(F.lit(1.0) / F.log2(r + F.lit(1.0)), F.lit(0.0))),
    }
    return [exprs[w].alias(w) for w in which]


def logloss_expr(label: str = "product_item", proba: str = "proba") -> Column:
    p = F.element_at(F.col(proba), F.col(label).cast("int") + 1)
    return -F.avg(F.log(F.greatest(F.least(p, F.lit(1.0 - EPS)), F.lit(EPS))))


def auc_per_class(df: DataFrame, label: str = "product_item", proba: str = "proba") -> DataFrame:
    """(class_id, auc) one-vs-rest with ties counted 1/2; NULL when a class
    has no positives or no negatives."""
    long = df.select(F.col(label).cast("long").alias("_y"),
                     F.posexplode(proba).alias("class_id", "s"))
    long = long.select(F.col("class_id").cast("long").alias("class_id"), "s",
                       (F.col("_y") == F.col("class_id")).cast("long").alias("pos"))
    per = long.groupBy("class_id", "s").agg(F.sum("pos").alias("P"),
                                            F.sum(F.lit(1) - F.col("pos")).alias("N"))
    # buckets by log-odds: probabilities pile up near 0 and 1 and spread there
    s = F.col("s")
    odds = F.when(s <= 0, F.lit(-800.0)).when(s >= 1, F.lit(800.0)).otherwise(F.log(s) - F.log(F.lit(1.0) - s))
    per = per.withColumn("b", F.floor(odds * F.lit(256.0)).cast("long"))
    bt = per.groupBy("class_id", "b").agg(F.sum("N").alias("bn"))
    wb = Window.partitionBy("class_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.withColumn("n_below_b", F.coalesce(F.sum("bn").over(wb), F.lit(0))).drop("bn")
    ws = Window.partitionBy("class_id", "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.join(bt, ["class_id", "b"])
           .withColumn("n_below", F.col("n_below_b") + F.coalesce(F.sum("N").over(ws), F.lit(0))))
    contrib = F.col("P") * F.col("n_below") + F.lit(0.5) * F.col("P") * F.col("N")
    agg = per.groupBy("class_id").agg(F.sum(contrib).alias("num"), F.sum("P").alias("P"),
                                      F.sum("N").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("num") / (F.col("P") * F.col("N")))
    return agg.select("class_id", auc.alias("auc"))


def auc_macro(df: DataFrame, label: str = "product_item", proba: str = "proba") -> DataFrame:
    """Q-08: unweighted mean over classes (NULL if any class is undefined)."""
    pc = auc_per_class(df, label, proba)
    return pc.agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("auc"))


METRICS = ("auc", "logloss", "mrr_k", "recall_k", "hr_k", "ndcg_k")


def score_all(df: DataFrame, k: int, methods=("auc", "logloss", "hr_k", "ndcg_k"),
              label: str = "product_item", proba: str = "proba") -> DataFrame:
    """Q-10: metrics in the requested order as long rows (metric, score)."""
    for m in methods:
        if m not in METRICS:
            raise ValueError(f"unknown metric {m!r}")
    row_metrics = [m for m in methods if m not in ("auc",)]
    exprs = []
    rk = [m for m in row_metrics if m != "logloss"]
    if rk:
        exprs += rank_metrics(df, k, label, proba, rk)
    if "logloss" in row_metrics:
        exprs.append(logloss_expr(label, proba).alias("logloss"))
    wide = df.agg(*exprs) if exprs else None
    if "auc" in methods:
        a = auc_macro(df, label, proba)
        wide = a if wide is None else wide.crossJoin(a)  # 1 row x 1 row
    pairs = ", ".join(f"{i}, '{m}', CAST({m} AS DOUBLE)" for i, m in enumerate(methods))
    return wide.selectExpr(f"stack({len(methods)}, {pairs}) AS (ord, metric, score)")
