"""A-06..A-09: reports over experiment result logs (long rows).

All are grouped aggregations; the Welch test joins the (small) per-group
moment table with itself - target model vs every baseline - and computes
the t-distribution tail in an Arrow UDF over that small table (no SciPy:
a quadrature of the density).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pivot_mean(df: DataFrame, row: str, col: str, value: str, values: list | None = None) -> DataFrame:
    """A-06: mean of ``value`` by ``row`` x ``col`` as a grid (pivot values
    given -> no extra job to discover them)."""
    return df.groupBy(row).pivot(col, values).agg(F.avg(value))


def mean_se(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A-07: mean and standard error (sample std / sqrt(n))."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"),
                                 (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"))


def factor_means(df: DataFrame, factor: str, values: list[str]) -> DataFrame:
    """A-08: mean of each value column per factor level."""
    return df.groupBy(factor).agg(*[F.avg(v).alias(v) for v in values])


_NODES, _NODE_WEIGHTS = np.polynomial.legendre.leggauss(24)


def _tail(power: float, angle: float) -> float:
    """Integral over [angle, pi/2] of (cos x / cos angle) ** power, by
    Gauss-Legendre panels whose widths halve towards the lower end, so a
    falling-off at any scale is resolved."""
    length = math.pi / 2 - angle
    edges = np.concatenate([[0.0], length * 0.5 ** np.arange(60, -1, -1)])
    half = np.diff(edges)[:, None] / 2
    x = edges[:-1, None] + half * (1 + _NODES)
    # cos(angle + x) / cos(angle) without cancellation
    ratio = np.maximum(np.cos(x) - math.tan(angle) * np.sin(x), 0.0)
    with np.errstate(divide="ignore"):
        value = np.exp(power * (np.log1p(ratio - 1.0) if power else np.zeros_like(ratio)))
    return float((value * half * _NODE_WEIGHTS).sum())


def t_two_sided_p(t: float, df: float) -> float | None:
    """Two-sided tail of Student's t: with t = sqrt(df) tan x its density is
    proportional to cos(x) ** (df - 1), so the tail is a ratio of two
    integrals.  From ``df`` 1e7 on the normal tail differs by less than 1e-8."""
    if t is None or df is None or not math.isfinite(df) or df <= 0 or math.isnan(t):
        return None
    if df >= 1e7:
        return math.erfc(abs(t) / math.sqrt(2.0))
    angle = math.atan(abs(t) / math.sqrt(df))
    scale = math.exp((df - 1) * math.log(math.cos(angle))) if angle < math.pi / 2 else 0.0
    return min(1.0, scale * _tail(df - 1, angle) / _tail(df - 1, 0.0))


@F.pandas_udf(T.DoubleType())
def _p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(t, df)], dtype="float64")


def welch(df: DataFrame, target: str, keys: list[str], model: str, value: str, alpha: float = 0.01,
          lower_is_better=("logloss",), metric_col: str = "metric", with_p: bool = True) -> DataFrame:
    """A-09: Welch two-sided t-test of ``target`` vs every other model per
    ``keys``; Improved = lower mean for the listed metrics, higher otherwise."""
    st = df.groupBy(*keys, model).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"),
                                      F.var_samp(value).alias("v"))
    a = st.where(F.col(model) == target).select(*keys, F.col("n").alias("na"), F.col("m").alias("target_mean"),
                                               F.col("v").alias("va"))
    b = st.where(F.col(model) != target).select(*keys, F.col(model).alias("baseline"), F.col("n").alias("nb"),
                                               F.col("m").alias("baseline_mean"), F.col("v").alias("vb"))
    j = a.join(b, keys)
    sa, sb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    ok = (F.col("na") > 1) & (F.col("nb") > 1) & ((F.col("va") > 0) | (F.col("vb") > 0))  # else undefined
    t = F.when(ok, (F.col("target_mean") - F.col("baseline_mean")) / F.sqrt(sa + sb))
    dof = F.when(ok, F.pow(sa + sb, 2) / (F.pow(sa, 2) / (F.col("na") - 1) + F.pow(sb, 2) / (F.col("nb") - 1)))
    better = F.when(F.col(metric_col).isin(list(lower_is_better)), F.col("target_mean") < F.col("baseline_mean")) \
        .otherwise(F.col("target_mean") > F.col("baseline_mean")) if metric_col in keys else \
        (F.col("target_mean") > F.col("baseline_mean"))
    out = j.select(*keys, "baseline", "target_mean", "baseline_mean", t.alias("t"), dof.alias("df"),
                   better.alias("improved"))
    if with_p:
        out = out.withColumn("p_value", _p_udf(F.col("t"), F.col("df")))
        out = out.withColumn("significant", F.col("p_value") < alpha)
    return out
