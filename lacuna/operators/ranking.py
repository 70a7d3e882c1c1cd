"""Q-01..Q-03: probability tables and top-k.

The probability matrix travels as one ``array<double>`` column ``proba``
(position = class code), so top-k is a per-row array sort: no shuffle, no
window.  ``proba_long`` is the long (row_id, class_id, proba) form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Softmax of an array *column* (pass a column, not an expression: the
    lambdas would re-evaluate an expression per element)."""
    m = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / s)


def with_softmax(df: DataFrame, logits: list[Column], out: str = "proba") -> DataFrame:
    """Append ``out`` = softmax of K scalar logit expressions, in staged
    projections (logits, max, exps, normalise) so each is computed once per
    row inside generated code; no higher-order lambdas."""
    k = len(logits)
    tmp = [f"_lg{i}" for i in range(k)]
    x = df.select("*", *[l.alias(t) for l, t in zip(logits, tmp)])
    x = x.select("*", (F.greatest(*[F.col(t) for t in tmp]) if k > 1 else F.col(tmp[0])).alias("_lmax"))
    x = x.select(*[c for c in df.columns], *[F.exp(F.col(t) - F.col("_lmax")).alias(t) for t in tmp])
    tot = F.col(tmp[0])
    for t in tmp[1:]:
        tot = tot + F.col(t)
    x = x.select("*", tot.alias("_lsum"))
    return x.select(*df.columns, F.array(*[F.col(t) / F.col("_lsum") for t in tmp]).alias(out))


def proba_long(df: DataFrame, row_id: str = "row_id", proba: str = "proba",
               classes: list | None = None) -> DataFrame:
    """Q-01 wide -> long: (row_id, class_id, proba)."""
    x = df.select(row_id, F.posexplode(proba).alias("_pos", "proba"))
    cid = F.col("_pos") if classes is None else F.element_at(F.array(*[F.lit(c) for c in classes]),
                                                              F.col("_pos") + 1)
    return x.select(row_id, cid.cast("long").alias("class_id"), "proba")


def proba_wide(long_df: DataFrame, n_classes: int, row_id: str = "row_id") -> DataFrame:
    """Q-01 long -> wide: one array per row, position = class id (0..K-1).
    Grouped by row: each group holds exactly K values (bounded)."""
    g = long_df.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("class_id", "proba"))).alias("_m"))
    arr = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                      lambda i: F.coalesce(F.element_at(F.col("_m"), i.cast("long")), F.lit(0.0)))
    return g.select(row_id, arr.alias("proba"))


def topk_array(proba: Column, k: int) -> Column:
    """Q-02: array of struct(class_id, proba), k largest, ties -> lower class."""
    pairs = F.transform(proba, lambda p, i: F.struct((-p).alias("neg"), i.cast("long").alias("class_id")))
    top = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(top, lambda s: F.struct(s["class_id"].alias("class_id"), (-s["neg"]).alias("proba")))


def topk_long(df: DataFrame, k: int, row_id: str = "row_id", proba: str = "proba") -> DataFrame:
    """Q-02 long: (row_id, rank 1..k, class_id, proba)."""
    x = df.select(row_id, F.posexplode(topk_array(F.col(proba), k)).alias("_r", "_s"))
    return x.select(row_id, (F.col("_r") + 1).cast("long").alias("rank"),
                    F.col("_s.class_id").alias("class_id"), F.col("_s.proba").alias("proba"))


def recommend_wide(df: DataFrame, k: int, row_id: str = "row_id", proba: str = "proba") -> DataFrame:
    """Q-03: items only, columns top1..topk."""
    t = topk_array(F.col(proba), k)
    return df.select(row_id, *[t[i]["class_id"].alias(f"top{i + 1}") for i in range(k)])
