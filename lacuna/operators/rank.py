"""N-02: distributed exact ranks, by a keyed draw and by value.

An unpartitioned ``Window.orderBy`` plans ``Exchange SinglePartition`` and
would pull every row through one task.  Instead rows are placed in 65,536
hash buckets monotone in the draw (``bucket = floor(u * 65536)``):

1. ``groupBy(parts, bucket).count()`` (map-side partial aggregation; the
   output has at most |parts| x 65,536 rows whatever the data size),
2. a cumulative offset per bucket over that small table,
3. ``row_number()`` inside (parts, bucket) + offset.

Because the buckets are uniform hashes, a hot partition key (one class with a
third of all rows) is still spread over 65,536 window groups: no skewed task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.draws import bucket_of
from lacuna.session import stage

#: Rows of one value-range bucket that positions are numbered in.
BUCKET_ROWS = 500_000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a side that is usually small.  Nothing is counted beforehand and
    no broadcast is forced: adaptive execution measures the side's bytes once
    and broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``."""
    return big.join(small, on=on, how=how)


def rank_by_draw(df: DataFrame, u: str, key: str, parts: list[str] | None = None,
                 out: str = "_rank") -> DataFrame:
    """0-based exact rank of each row within ``parts`` ordered by (u, key).

    ``u`` must be a column in [0, 1) (a keyed draw); ``key`` breaks ties."""
    parts = list(parts or [])
    b = df.withColumn("_bkt", bucket_of(F.col(u)))
    counts = b.groupBy(*parts, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w_cum = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*parts, "_bkt",
                            F.coalesce(F.sum("_n").over(w_cum), F.lit(0)).alias("_off"))
    joined = b.join(offsets, on=parts + ["_bkt"])
    w_row = Window.partitionBy(*parts, "_bkt").orderBy(F.col(u), F.col(key))
    return (joined.withColumn(out, (F.row_number().over(w_row) - 1 + F.col("_off")).cast("long"))
            .drop("_bkt", "_off"))


def dense_codes(values: DataFrame, col: str, out: str = "idx", start: int = 0) -> DataFrame:
    """Sorted distinct values of ``col`` -> consecutive codes from ``start``
    (``values`` must already be distinct and non-null), by the same
    distributed positions at every size."""
    return ordered_positions(values.select(col), [col], out, start)


def _before(u: Column, key: Column, thr) -> Column:
    """(u, key) <= threshold (u*, key*)."""
    tu, tk = thr
    return (u < F.lit(tu)) | ((u == F.lit(tu)) & (key <= F.lit(tk)))


def kth_keys(df: DataFrame, k_by_group: dict, g: str, u: str, key: str,
             max_exact: int = 1 << 14) -> dict:
    """Exact selection: for each group value, the key (u*, key*) of its k-th
    smallest row by (u, key) (1-based).

    No row-level sort: each level is one ``groupBy(group, bucket).count()``
    over 16 more bits of ``u`` (map-side partial aggregation, output bounded
    by #groups x 65,536); only the boundary bucket is refined, and the final
    exact ``row_number`` runs on at most ``max_exact`` candidate rows per
    group.  Returns ``None`` for k <= 0 and ``(2.0, None)`` ("everything")
    when k exceeds the group size."""
    out: dict = {gv: None for gv, k in k_by_group.items() if k <= 0}
    todo = {gv: int(k) for gv, k in k_by_group.items() if k > 0}
    prefix = {gv: 0 for gv in todo}
    bits = 0
    while todo:
        nb = bits + 16
        kmap = F.create_map(*[x for gv, k in todo.items() for x in (F.lit(gv), F.lit(k))])
        pmap = F.create_map(*[x for gv, p in prefix.items() if gv in todo for x in (F.lit(gv), F.lit(p))])
        cand = df.where(F.col(g).isin(list(todo)) &
                        (F.floor(F.col(u) * F.lit(float(2 ** bits))).cast("long") ==
                         F.element_at(pmap, F.col(g))))
        counts = (cand.groupBy(g, F.floor(F.col(u) * F.lit(float(2 ** nb))).cast("long").alias("_b"))
                  .agg(F.count(F.lit(1)).alias("_n")))
        w = Window.partitionBy(g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        cum = counts.withColumn("_cb", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        kk = F.element_at(kmap, F.col(g))
        hits = cum.where((F.col("_cb") < kk) & (kk <= F.col("_cb") + F.col("_n"))).collect()
        found = {r[g]: r for r in hits}
        for gv in list(todo):
            if gv not in found:          # k larger than the group: everything
                out[gv] = (2.0, None)
                del todo[gv]
        exact = {}
        for gv, r in found.items():
            krem = todo[gv] - r["_cb"]
            if r["_n"] <= max_exact or nb >= 48:
                exact[gv] = (r["_b"], krem)
                del todo[gv]
            else:
                prefix[gv] = r["_b"]
                todo[gv] = krem
        if exact:
            conds = None
            for gv, (b, _) in exact.items():
                c = (F.col(g) == F.lit(gv)) & (F.floor(F.col(u) * F.lit(float(2 ** nb))).cast("long") == F.lit(b))
                conds = c if conds is None else conds | c
            kx = F.create_map(*[x for gv, (_, k) in exact.items() for x in (F.lit(gv), F.lit(k))])
            wr = Window.partitionBy(g).orderBy(F.col(u), F.col(key))
            picked = (df.where(conds).withColumn("_rn", F.row_number().over(wr))
                      .where(F.col("_rn") == F.element_at(kx, F.col(g)))
                      .select(g, u, key).collect())
            for r in picked:
                out[r[g]] = (r[u], r[key])
        bits = nb
    return out


def first_k_flag(u: Column, key: Column, thr) -> Column:
    """Boolean: row is among the first k (threshold from ``kth_keys``)."""
    if thr is None:
        return F.lit(False)
    if thr[1] is None:
        return F.lit(True)
    return _before(u, key, thr)


def _ranged(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """``df`` staged in range partitions of the whole order key, with the
    partition's number in ``_rb`` (fixed by the write, so every later branch
    and retry agrees).  The number of partitions follows the row count."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + df.count() // BUCKET_ROWS)
    return stage(df.repartitionByRange(n, *order_cols).withColumn("_rb", F.spark_partition_id()), "ranged")


def ordered_positions(df: DataFrame, order_cols: list[str], out: str = "pos", start: int = 1) -> DataFrame:
    """Exact position of every row in ``order_cols`` order without a
    single-task sort: rows go to range partitions of the whole key, a table
    with one count per partition gives offsets, and rows are numbered inside
    their partition."""
    b = _ranged(df, order_cols)
    counts = b.groupBy("_rb").agg(F.count(F.lit(1)).alias("_n"))
    w_cum = Window.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_rb", F.coalesce(F.sum("_n").over(w_cum), F.lit(0)).alias("_off"))
    w_row = Window.partitionBy("_rb").orderBy(*[F.col(c) for c in order_cols])
    return (b.join(F.broadcast(offs), "_rb")  # one row per range partition: a proven bound
            .withColumn(out, (F.row_number().over(w_row) - 1 + F.col("_off") + start).cast("long"))
            .drop("_rb", "_off"))


def nearest_value(query_df: DataFrame, ref_df: DataFrame, col: str, out: str = "snapped") -> DataFrame:
    """F-10: for each query row the nearest ``ref_df[col]`` value; ties go
    to the larger value, values beyond the range clip to the ends.

    A distributed as-of join in both directions over *distinct* values (so a
    value held by any number of rows is looked up once): values are range
    partitioned, a running last value in each order gives the neighbours
    inside a partition, and those in other partitions come from a table with
    one (min, max) per partition.  Query rows then join their value."""
    ref = ref_df.select(F.col(col).alias("_v")).where("_v IS NOT NULL").distinct().withColumn("_is_ref", F.lit(1))
    ask = query_df.select(F.col(col).alias("_v")).where("_v IS NOT NULL").distinct().withColumn("_is_ref", F.lit(0))
    u = _ranged(ask.unionByName(ref), ["_v"])
    rv = F.when(F.col("_is_ref") == 1, F.col("_v"))
    # both neighbours from running (growing) frames: an "unbounded
    # following" frame would be recomputed per row (quadratic)
    w = Window.partitionBy("_rb").orderBy("_v", "_is_ref")
    w_desc = Window.partitionBy("_rb").orderBy(F.col("_v").desc(), F.col("_is_ref").desc())
    inside = u.select(
        "*",
        F.last(rv, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_lo"),
        F.last(rv, ignorenulls=True).over(w_desc.rowsBetween(Window.unboundedPreceding, 0)).alias("_hi"))
    edges = u.groupBy("_rb").agg(F.min(rv).alias("_pmin"), F.max(rv).alias("_pmax"))
    we = Window.orderBy("_rb")
    edges = edges.select(
        "_rb",
        F.max("_pmax").over(we.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_lo"),
        F.min("_pmin").over(we.rowsBetween(1, Window.unboundedFollowing)).alias("_carry_hi"))
    j = inside.where(F.col("_is_ref") == 0).join(F.broadcast(edges), "_rb")  # one row per range partition
    lo = F.coalesce(F.col("_lo"), F.col("_carry_lo"))
    hi = F.coalesce(F.col("_hi"), F.col("_carry_hi"))
    v = F.col("_v")
    pick = F.when(hi.isNull(), lo).when(lo.isNull(), hi).when((v - lo) < (hi - v), lo).otherwise(hi)
    found = j.select("_v", pick.alias(out))
    return query_df.join(found, query_df[col] == found["_v"], "left").drop("_v")
