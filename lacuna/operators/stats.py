"""N-03 sufficient statistics and A-01..A-05 table profiles.

All are single aggregations (map-side partial aggregation, one small result
row per group), so their cost is one scan whatever the data size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suff_stats(df: DataFrame, xs: list[str], y: str | None = None) -> DataFrame:
    """N-03: n, sum x_i, sum x_i x_j (i <= j), sum x_i y as long rows (name, value)
    from ONE aggregation of p(p+3)/2 sums."""
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    for i, a in enumerate(xs):
        aggs.append(F.sum(F.col(a).cast("double")).alias(f"sum_{a}"))
        if y is not None:
            aggs.append(F.sum(F.col(a).cast("double") * F.col(y).cast("double")).alias(f"xy_{a}"))
        for b in xs[i:]:
            aggs.append(F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"xx_{a}_{b}"))
    row = df.agg(*aggs)
    names = row.columns
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return row.selectExpr(f"stack({len(names)}, {pairs}) AS (name, value)")


def gram(df: DataFrame, xs: list[str], y: str | None = None, weight: str | None = None):
    """N-03 as NumPy: (n, sum x, X'X, X'y, y'y) for rows where every x (and y)
    is present.  One aggregation; the p x p result is small."""
    import numpy as np

    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in xs + ([y] if y else [])])
    d = df.where(cond)
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = [F.sum(w).alias("n")]
    aggs += [F.sum(w * F.col(a)).alias(f"s{i}") for i, a in enumerate(xs)]
    aggs += [F.sum(w * F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(xs) for j, b in
             enumerate(xs) if j >= i]
    if y:
        aggs += [F.sum(w * F.col(a) * F.col(y)).alias(f"t{i}") for i, a in enumerate(xs)]
        aggs += [F.sum(w * F.col(y)).alias("sy"), F.sum(w * F.col(y) * F.col(y)).alias("yy")]
    r = d.agg(*aggs).first()
    p = len(xs)
    n = float(r["n"] or 0.0)
    s = np.array([float(r[f"s{i}"] or 0.0) for i in range(p)])
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = float(r[f"g{i}_{j}"] or 0.0)
    out = {"n": n, "sx": s, "xx": g}
    if y:
        out["xy"] = np.array([float(r[f"t{i}"] or 0.0) for i in range(p)])
        out["sy"] = float(r["sy"] or 0.0)
        out["yy"] = float(r["yy"] or 0.0)
    return out


def class_counts(df: DataFrame, item: str) -> DataFrame:
    """A-01: value_counts of the target (NULL class excluded)."""
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, cols: list[str], distinct: list[str] | None = None) -> DataFrame:
    """A-02: per column rows, max and min from one aggregation; the number of
    distinct values (of ``distinct``, by default every column) from one
    two-step aggregation per column over that column alone, so no row is
    expanded for several distinct counts."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        aggs += [F.max(c).cast("double").alias(f"max_{c}"), F.min(c).cast("double").alias(f"min_{c}")]
    parts = ", ".join(f"'{c}', n_rows, `max_{c}`, `min_{c}`" for c in cols)
    flat = df.agg(*aggs).selectExpr(f"stack({len(cols)}, {parts}) AS (col, n_rows, max, min)")
    counts = [df.groupBy(c).agg(F.lit(1).alias("_one")).agg(F.count(c).alias("nunique")).select(F.lit(c).alias("col"), "nunique")
              for c in (cols if distinct is None else distinct)]
    return flat.join(F.broadcast(reduce(DataFrame.unionByName, counts)), "col", "left")  # one row per column


def missing_pct(df: DataFrame, cols: list[str]) -> DataFrame:
    """A-03: NULL cells / (rows * cols) * 100."""
    nulls = reduce(lambda a, b: a + b, [F.sum(F.col(c).isNull().cast("long")) for c in cols])
    return df.agg((nulls.cast("double") / (F.count(F.lit(1)) * len(cols)) * 100).alias("missing_pct"))


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """A-04: column min/max vector (imputer bounds)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"min_{c}"), F.max(c).cast("double").alias(f"max_{c}")]
    row = df.agg(*aggs)
    parts = ", ".join(f"'{c}', `min_{c}`, `max_{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {parts}) AS (col, min, max)")
