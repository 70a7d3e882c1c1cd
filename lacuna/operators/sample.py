"""T-01..T-04, U-04: row limit, rare-class filter, seeded shuffle,
guaranteed split, membership filter.

The split never sorts all rows in one task: the shuffle order is the keyed
draw ``u(seed, 'shuffle', row_id)``; the first three rows of each class come
from three minima of (draw, row id) packed into one decimal (partial hash
aggregation, so a class holding a third of the data is combined map-side), and the
train/valid cut points among the remaining rows are found by exact bucketed
selection (``kth_keys``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.draws import uniform
from lacuna.operators.dictionary import factorize
from lacuna.operators.rank import first_k_flag, join_small, kth_keys, ordered_positions, rank_by_draw
from lacuna.session import cut_lineage
from lacuna.spec import FeatureSpec, check_ratios


def head_limit(df: DataFrame, n: int | None, order_by: str = "row_id") -> DataFrame:
    """T-01: the first ``n`` rows in row-id order; n None or <= 0 keeps all.
    Rows are numbered by range partitions, so a large ``n`` does not meet in
    one task."""
    if n is None or n <= 0:
        return df
    return ordered_positions(df, [order_by], "_at").where(F.col("_at") <= n).drop("_at")


def member_filter(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """U-04: ``isin`` as a left-semi join."""
    return join_small(df, keys, on=on, how="left_semi")


def rare_class_filter(df: DataFrame, item: str, min_count: int = 3, refactorize: bool = True,
                      out: str | None = None) -> DataFrame:
    """T-02: keep classes with >= ``min_count`` rows (null class dropped),
    then re-encode the survivors 0..K-1 in sorted order (F-01)."""
    keep = (df.where(F.col(item).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") >= min_count).select(item))
    kept = member_filter(df, keep, on=item)
    return factorize(kept, item, out or item, null_code=None) if refactorize else kept


def shuffle_order(df: DataFrame, seed: int, row_id: str = "row_id", out: str = "pos") -> DataFrame:
    """T-03: seeded shuffle as an explicit position column (0-based)."""
    d = df.withColumn("_u", uniform(seed, "shuffle", row_id))
    return rank_by_draw(d, "_u", row_id, out=out).drop("_u")


def split_guaranteed(df: DataFrame, spec: FeatureSpec, train_ratio: float = 0.7,
                     val_ratio: float = 0.1, seed: int = 42, out: str = "split") -> DataFrame:
    """T-04: one DataFrame with ``split`` in {train, valid, test}.

    After the seeded shuffle, each class's occurrence #0 goes to train, #1 to
    valid, #2 to test; of the remaining rows in shuffled order the first
    max(0, floor(N*tr) - #occ0) go to train, the next
    max(0, floor(N*va) - #occ1) to valid, the rest to test."""
    check_ratios(train_ratio, val_ratio)
    item, rid = spec.item, spec.row_id
    # several passes read the input: materialise it once
    d = cut_lineage(df.withColumn("_u", uniform(seed, "shuffle", rid)))
    # (draw, row id) as one number: a fixed-width minimum stays in hash aggregation
    whole = lambda n: F.expr(f"CAST('{n}' AS DECIMAL(20,0))")
    order = (F.floor(F.col("_u") * F.lit(float(2 ** 52))).cast("decimal(17,0)") * whole(2 ** 64)
             + F.col(rid).cast("decimal(20,0)") + whole(2 ** 63)).cast("decimal(38,0)")
    d = d.withColumn("_s", order)
    tbl = d.select(item, "_s")
    t1 = tbl.groupBy(item).agg(F.min("_s").alias("_f1"))
    t2 = tbl.join(t1, item).where(F.col("_s") > F.col("_f1")).groupBy(item).agg(F.min("_s").alias("_f2"))
    t3 = tbl.join(t2, item).where(F.col("_s") > F.col("_f2")).groupBy(item).agg(F.min("_s").alias("_f3"))
    marks = cut_lineage(t1.join(t2, item, "left").join(t3, item, "left"))
    tot = marks.agg(F.count(F.lit(1)).alias("n0"), F.count("_f2").alias("n1")).first()
    n_rows = d.count()
    need_train = max(0, int(n_rows * train_ratio) - tot["n0"])
    need_val = max(0, int(n_rows * val_ratio) - tot["n1"])
    m = join_small(d, marks, item, how="left")
    cc = (F.when(F.col("_s") == F.col("_f1"), 0).when(F.col("_s") == F.col("_f2"), 1)
          .when(F.col("_s") == F.col("_f3"), 2).otherwise(3))
    m = m.withColumn("_cc", cc).drop("_f1", "_f2", "_f3", "_s")
    rest = (m.where(F.col("_cc") == 3)
            .select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("_g"), "_u", rid))
    thr = kth_keys(rest, {"a": need_train, "b": need_train + need_val}, "_g", "_u", rid)
    u, k = F.col("_u"), F.col(rid)
    lab = (F.when(F.col("_cc") == 0, "train").when(F.col("_cc") == 1, "valid")
           .when(F.col("_cc") == 2, "test")
           .when(first_k_flag(u, k, thr["a"]), "train")
           .when(first_k_flag(u, k, thr["b"]), "valid")
           .otherwise("test"))
    return m.withColumn(out, lab).drop("_cc", "_u")


def split_frames(split_df: DataFrame, col: str = "split") -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(split_df.where(F.col(col) == s).drop(col) for s in ("train", "valid", "test"))
