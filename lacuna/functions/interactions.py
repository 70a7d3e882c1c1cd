"""F-13 to F-16: field-interaction maths and view perturbations as
column expressions (F-14 as an Arrow kernel: a cross layer feeds each
layer's dot product back into every element, which nested array lambdas
would recompute per element; F-15 as one for its block matrix products)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.draws import uniform
from lacuna.operators.missing import py_uniform


def fm_pairs(emb: Column, n_fields: int, dim: int) -> Column:
    """F-13: 1/2 * sum_d ((sum_f v_fd)^2 - sum_f v_fd^2) over a flat array
    of n_fields x dim values (field-major)."""
    total = F.lit(0.0)
    for d in range(dim):
        vals = [emb[f * dim + d].cast("double") for f in range(n_fields)]
        s = vals[0]
        q = vals[0] * vals[0]
        for v in vals[1:]:
            s = s + v
            q = q + v * v
        total = total + (s * s - q)
    return F.lit(0.5) * total


def cross_weights(dim: int, layers: int, seed: int = 7):
    """Fixed keyed weights (w_l, b_l) for the cross-layer operator."""
    w = [[py_uniform(seed, f"cross|{l}", d) - 0.5 for d in range(dim)] for l in range(layers)]
    b = [[0.01 * (py_uniform(seed, f"bias|{l}", d) - 0.5) for d in range(dim)] for l in range(layers)]
    return w, b


def cross_layers(x0: Column, weights) -> Column:
    """F-14: x_{l+1} = x0 * (x_l . w_l) + b_l + x_l, per Arrow batch."""
    w, b = (np.array(a) for a in weights)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _cross(col: pd.Series) -> pd.Series:
        x0m = np.stack(col.to_numpy()).astype("float64")
        xl = x0m
        for l in range(len(w)):
            dot = (xl * w[l][None, :]).sum(axis=1, keepdims=True)
            xl = x0m * dot + b[l][None, :] + xl
        return pd.Series(list(xl))

    return _cross(x0)


def cross_sql(x0: str, weights) -> str:
    w, b = weights
    xl = x0
    for l in range(len(w)):
        wl = "[" + ", ".join(repr(v) for v in w[l]) + "]::DOUBLE[]"
        bl = "[" + ", ".join(repr(v) for v in b[l]) + "]::DOUBLE[]"
        xl = (f"list_transform(list_zip({x0}, {xl}, {bl}), lambda t: t[1] * list_dot_product({xl}, {wl}) + t[3] + t[2])")
    return xl


#: Weights of bilinear pairs travel with each task: at most so many numbers.
MAX_WEIGHTS = 1 << 22


def bilinear_weights(table: DataFrame, n_fields: int, dim: int) -> np.ndarray:
    """(1 or fields, dim, dim) from a table (field, row, col, weight); one
    matrix without a field (null) is shared by all.  Cells left out are zero."""
    cells = table.select(F.coalesce(F.col("field"), F.lit(-1)).cast("int"), F.col("row").cast("int"), F.col("col").cast("int"),
                         F.col("weight").cast("double")).limit(MAX_WEIGHTS + 1).collect()
    if len(cells) > MAX_WEIGHTS:
        raise ValueError(f"bilinear weights hold more than {MAX_WEIGHTS} numbers")
    shared = {c[0] for c in cells} <= {-1}
    if not shared and any(c[0] < 0 for c in cells):
        raise ValueError("bilinear weights are either shared or per field")
    out = np.zeros((1 if shared else n_fields, dim, dim))
    for f, r, c, v in cells:
        out[max(f, 0), r, c] = v
    return out


def bilinear_pairs(emb: Column, n_fields: int, dim: int, weights) -> Column:
    """F-15: (v_i W) * v_j for fields i < j in the order of (i, j), flat, over
    an array of n_fields x dim values; ``weights`` is one (dim, dim) matrix for
    all fields or (n_fields, dim, dim).  Null, shorter or longer arrays and
    arrays with a null give null."""
    w = np.asarray(weights, float).reshape(-1, dim, dim)
    if len(w) not in (1, n_fields) or w.size > MAX_WEIGHTS:
        raise ValueError("bilinear weights: one matrix or one for each field")
    first, second = np.triu_indices(n_fields, 1)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _pairs(col: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(col), dtype=object)
        good = np.flatnonzero(col.notna().to_numpy())
        if len(good):
            v = np.stack(col.to_numpy()[good]).astype("float64").reshape(len(good), n_fields, dim)
            left = np.matmul(v.transpose(1, 0, 2), w).transpose(1, 0, 2)
            found = (left[:, first] * v[:, second]).reshape(len(good), -1)
            for k, row in zip(good, found):
                out[k] = row
        return out

    whole = (F.size(emb) == n_fields * dim) & ~F.exists(emb, lambda x: x.isNull())
    return _pairs(F.when(whole, emb.cast("array<double>")))


def pair_fields(n_fields: int) -> list:
    """The (i, j) of each block of ``bilinear_pairs``."""
    return [(i, j) for i in range(n_fields) for j in range(i + 1, n_fields)]


def perturb_random(c: str, ratio: float, seed: int, row_id: str = "row_id") -> Column:
    """F-16 random: keep a cell with probability 1 - r, else 0."""
    if ratio <= 0:
        return F.col(c).cast("double")
    keep = uniform(seed, f"keep|{c}", row_id) < F.lit(1 - ratio)
    return F.when(keep, F.col(c).cast("double")).otherwise(F.lit(0.0))


def perturb_noise(c: str, ratio: float, seed: int, row_id: str = "row_id") -> Column:
    """F-16 noise: + U(-r, r) (dense features only)."""
    if ratio <= 0:
        return F.col(c).cast("double")
    return F.col(c) + F.lit(ratio) * (F.lit(2.0) * uniform(seed, f"noise|{c}", row_id) - F.lit(1.0))


def perturb_feature(cols: list[str], ratio: float, seed: int, batch: str) -> list[Column]:
    """F-16 feature: in every batch zero max(1, floor(p r)) columns, chosen
    by a keyed draw on (batch, column name)."""
    if ratio <= 0:
        return [F.col(c).cast("double").alias(c) for c in cols]
    k = max(1, int(len(cols) * ratio))
    u = {c: uniform(seed, "feat", F.concat_ws("|", F.col(batch).cast("string"), F.lit(c))) for c in cols}
    out = []
    for c in cols:
        rank = F.lit(0)
        for o in cols:
            if o == c:
                continue
            before = (u[o] < u[c]) | ((u[o] == u[c]) & F.lit(o < c))
            rank = rank + before.cast("int")
        out.append(F.when(rank < k, F.lit(0.0)).otherwise(F.col(c).cast("double")).alias(c))
    return out
