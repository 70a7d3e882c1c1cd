"""T-05..T-09: controlled injection of missing cells.

All choices are keyed draws ``u(seed, salt, row_id)``, so the same cells are
masked whatever the partitioning.  Exact counts (floor(n * ratio)) come from
bucketed selection (``kth_keys``): one aggregation per 16 bits of the draw,
never a sort of all rows; the target column is never masked.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.draws import uniform
from lacuna.operators.rank import first_k_flag, kth_keys
from lacuna.spec import FeatureSpec

MODES = ("random", "row", "col", "row_partial")
ROW_PARTIAL_RATIO = 0.8


def py_uniform(seed, salt, key) -> float:
    """Driver-side twin of ``draws.uniform`` (for column-level choices)."""
    h = hashlib.md5(f"{seed}|{salt}|{key}".encode()).hexdigest()[:13]
    return int(h, 16) / float(2 ** 52)


def inject_missing(df: DataFrame, spec: FeatureSpec, ratio: float, seed: int = 42,
                   mode: str = "random") -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown missing mode {mode!r}")
    if ratio <= 0.0:                                                    # T-09
        return df
    feats, rid = spec.features, spec.row_id
    if mode == "random":                                                # T-05
        counts = df.agg(*[F.count(c).alias(c) for c in feats]).first()
        quota = {c: int(counts[c] * ratio) for c in feats}
        cells = F.array(*[F.when(F.col(c).isNotNull(),
                                 F.struct(F.lit(c).alias("g"), uniform(seed, f"miss|{c}", rid).alias("u")))
                          for c in feats])
        long = (df.select(rid, F.explode(cells).alias("_c")).where(F.col("_c").isNotNull())
                .select(F.col("_c.g").alias("g"), F.col("_c.u").alias("u"), rid))
        thr = kth_keys(long, quota, "g", "u", rid)
        return df.withColumns({
            c: F.when(first_k_flag(uniform(seed, f"miss|{c}", rid), F.col(rid), thr[c]), F.lit(None))
               .otherwise(F.col(c)) for c in feats})
    if mode == "row":                                                   # T-06
        n = df.count()
        u = uniform(seed, "row", rid)
        long = df.select(F.lit("r").alias("g"), u.alias("u"), rid)
        thr = kth_keys(long, {"r": int(n * ratio)}, "g", "u", rid)["r"]
        hit = first_k_flag(u, F.col(rid), thr)
        return df.withColumns({c: F.when(hit, F.lit(None)).otherwise(F.col(c)) for c in feats})
    if mode == "col":                                                   # T-07
        k = int(len(feats) * ratio)
        chosen = sorted(feats, key=lambda c: (py_uniform(seed, "col", c), c))[:k]
        return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in chosen})
    # row_partial                                                         T-08
    n = df.count()
    u = uniform(seed, "rowp", rid)
    long = df.select(F.lit("r").alias("g"), u.alias("u"), rid)
    thr = kth_keys(long, {"r": int(n * ratio)}, "g", "u", rid)["r"]
    hit = first_k_flag(u, F.col(rid), thr)
    avail = F.filter(F.array(*[F.when(F.col(c).isNotNull(),
                                      F.struct(uniform(seed, f"cell|{c}", rid).alias("u"), F.lit(c).alias("name")))
                               for c in feats]), lambda s: s.isNotNull())
    x = df.withColumn("_av", avail)
    n_drop = F.floor(F.size("_av") * F.lit(ROW_PARTIAL_RATIO)).cast("int")
    drop = F.transform(F.slice(F.array_sort("_av"), 1, F.greatest(n_drop, F.lit(1))), lambda s: s["name"])
    x = x.withColumn("_drop", F.when(hit & (n_drop > 0), drop).otherwise(F.array().cast("array<string>")))
    return x.withColumns({c: F.when(F.array_contains("_drop", c), F.lit(None)).otherwise(F.col(c))
                          for c in feats}).drop("_av", "_drop")
