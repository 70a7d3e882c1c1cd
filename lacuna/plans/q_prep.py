"""Draws, ranks, sampling, missingness, encodings and profiles
(N-01..N-03, T-01..T-09, U-04, P-01, P-03, P-19, F-01..F-11, A-01..A-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.draws import normal, sql_normal, sql_uniform, uniform
from lacuna.functions.scale import MeanFillScale, MinMax, UniformBins, ZScore, assemble, missing_mask
from lacuna.operators import stats as S
from lacuna.operators.dictionary import factorize, apply_vocabulary, fit_vocabulary
from lacuna.operators.missing import inject_missing
from lacuna.operators.rank import nearest_value, rank_by_draw
from lacuna.operators.sample import head_limit, member_filter, rare_class_filter, shuffle_order
from lacuna.plans import oracle as O
from lacuna.plans.registry import query, r6
from lacuna.sources.fixtures import (NULLS_SQL, POLICY_SPEC, POLICY_SQL, policy, policy_nulls, with_sql)
from lacuna.sources.tables import read_table

FEATS = POLICY_SPEC.features


# ---------------------------------------------------------------- N-01..N-03

@query("keyed_draw", f"""
SELECT o_orderkey AS row_id, round({sql_uniform(42, 'u', 'o_orderkey')}, 6) AS u,
       round({sql_normal(42, 'z', 'o_orderkey')}, 6) AS z
FROM orders""")
def q_keyed_draw(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey"])
    return o.select(F.col("o_orderkey").alias("row_id"), r6(uniform(42, "u", "o_orderkey")).alias("u"),
                    r6(normal(42, "z", "o_orderkey")).alias("z"))


@query("global_rank", f"""
SELECT o_orderkey AS row_id,
       CAST(row_number() OVER (ORDER BY {sql_uniform(42, 'rank', 'o_orderkey')}, o_orderkey) - 1 AS BIGINT) AS rank
FROM orders""")
def q_global_rank(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey"]).withColumn("_u", uniform(42, "rank", "o_orderkey"))
    return rank_by_draw(o, "_u", "o_orderkey", out="rank").select(F.col("o_orderkey").alias("row_id"), "rank")


def _moments_sql():
    cols = ["seg", "nation", "age"]
    parts = ["SELECT 'n' AS name, CAST(count(*) AS DOUBLE) AS value FROM policy"]
    for i, a in enumerate(cols):
        parts.append(f"SELECT 'sum_{a}', CAST(sum({a}) AS DOUBLE) FROM policy")
        parts.append(f"SELECT 'xy_{a}', CAST(sum({a} * CAST(product_item AS DOUBLE)) AS DOUBLE) FROM policy")
        for b in cols[i:]:
            parts.append(f"SELECT 'xx_{a}_{b}', CAST(sum({a} * {b}) AS DOUBLE) FROM policy")
    return with_sql(POLICY_SQL) + "\nSELECT name, round(value, 2) AS value FROM (" + " UNION ALL ".join(parts) + ")"


@query("moments", _moments_sql())
def q_moments(spark, sf):
    """N-03: n, sum x, X'X, X'y in one aggregation."""
    st = S.suff_stats(policy(spark, sf), ["seg", "nation", "age"], "product_item")
    return st.select("name", F.round("value", 2).alias("value"))


# ---------------------------------------------------------------- T-01..T-04, U-04

@query("head_limit", with_sql(POLICY_SQL) + """
SELECT * FROM policy ORDER BY row_id LIMIT 1000""")
def q_head_limit(spark, sf):
    return head_limit(policy(spark, sf), 1000)


@query("rare_class_filter", """
WITH k AS (SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 30)
SELECT p_partkey, p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS name_code
FROM part WHERE p_name IN (SELECT p_name FROM k)""")
def q_rare_class_filter(spark, sf):
    p = read_table(spark, sf, "part", ["p_partkey", "p_name"]).withColumn("name_code", F.col("p_name"))
    return rare_class_filter(p, "name_code", 30).select("p_partkey", "p_name", "name_code")


@query("member_filter", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q_member_filter(spark, sf):
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    keys = (read_table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"])
            .where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey")))
    return member_filter(li, keys, "l_orderkey")


@query("shuffle", with_sql(POLICY_SQL) + f"""
SELECT row_id, CAST(row_number() OVER (ORDER BY {sql_uniform(42, 'shuffle', 'row_id')}, row_id) - 1 AS BIGINT) AS pos
FROM policy""")
def q_shuffle(spark, sf):
    return shuffle_order(policy(spark, sf), 42).select("row_id", "pos")


# ---------------------------------------------------------------- T-05..T-09

def _mask_sql(mode: str) -> str:
    cols = FEATS
    if mode == "random":
        return with_sql(NULLS_SQL) + "\nSELECT * FROM pnull"
    if mode == "noop":
        return with_sql(POLICY_SQL) + "\nSELECT * FROM policy"
    if mode in ("row", "row_partial"):
        salt = "row" if mode == "row" else "rowp"
        hit = (f"row_number() OVER (ORDER BY {sql_uniform(42, salt, 'row_id')}, row_id) "
               f"<= floor(count(*) OVER () * CAST(0.3 AS DOUBLE))")
        if mode == "row":
            sel = ", ".join(f"CASE WHEN hit THEN NULL ELSE {c} END AS {c}" for c in cols)
            return (with_sql(POLICY_SQL) + f"\n, h AS (SELECT *, {hit} AS hit FROM policy)\n"
                    f"SELECT row_id, {sel}, product_item FROM h")
        cells = " UNION ALL ".join(
            f"SELECT row_id, '{c}' AS name, {sql_uniform(42, 'cell|' + c, 'row_id')} AS u FROM h WHERE hit "
            f"AND {c} IS NOT NULL" for c in cols)
        sel = ", ".join(f"CASE WHEN row_id IN (SELECT row_id FROM dr WHERE name = '{c}') THEN NULL ELSE {c} END AS {c}"
                        for c in cols)
        return (with_sql(POLICY_SQL) + f"\n, h AS (SELECT *, {hit} AS hit FROM policy),\n"
                f"cells AS ({cells}),\n"
                "rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY u) AS rn, "
                "count(*) OVER (PARTITION BY row_id) AS na FROM cells),\n"
                "dr AS (SELECT row_id, name FROM rk WHERE rn <= floor(na * CAST(0.8 AS DOUBLE)))\n"
                f"SELECT row_id, {sel}, product_item FROM h")
    # col
    names = " UNION ALL ".join(f"SELECT '{c}' AS name, {sql_uniform(42, 'col', repr(c))} AS u" for c in cols)
    sel = ", ".join(f"CASE WHEN '{c}' IN (SELECT name FROM ch) THEN NULL ELSE {c} END AS {c}" for c in cols)
    return (with_sql(POLICY_SQL) + f"\n, nm AS ({names}),\n"
            f"ch AS (SELECT name FROM nm ORDER BY u, name LIMIT {int(len(cols) * 0.5)})\n"
            f"SELECT row_id, {sel}, product_item FROM policy")


@query("miss_random", _mask_sql("random"))
def q_miss_random(spark, sf):
    return policy_nulls(spark, sf)


@query("miss_row", _mask_sql("row"))
def q_miss_row(spark, sf):
    return inject_missing(policy(spark, sf), POLICY_SPEC, 0.3, 42, "row")


@query("miss_col", _mask_sql("col"))
def q_miss_col(spark, sf):
    return inject_missing(policy(spark, sf), POLICY_SPEC, 0.5, 42, "col")


@query("miss_row_partial", _mask_sql("row_partial"))
def q_miss_row_partial(spark, sf):
    return inject_missing(policy(spark, sf), POLICY_SPEC, 0.3, 42, "row_partial")


@query("miss_noop", _mask_sql("noop"))
def q_miss_noop(spark, sf):
    return inject_missing(policy(spark, sf), POLICY_SPEC, 0.0, 42, "random")


# ---------------------------------------------------------------- P-01, P-03, P-19, I-12

@query("complete_cases", with_sql(NULLS_SQL) + f"""
SELECT row_id, {', '.join(FEATS)}, product_item FROM pnull
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATS + ['product_item'])}""")
def q_complete_cases(spark, sf):
    """P-01 + P-03: drop rows with any NULL among all features."""
    return policy_nulls(spark, sf).select("row_id", *FEATS, "product_item").na.drop("any")


@query("round_codes", with_sql(NULLS_SQL) + """
, m AS (SELECT avg(seg) AS ms, avg(nation) AS mn, avg(region) AS mr FROM pnull)
SELECT row_id, CAST(round_even(coalesce(seg, ms), 0) AS BIGINT) AS seg,
       CAST(round_even(coalesce(nation, mn), 0) AS BIGINT) AS nation,
       CAST(round_even(coalesce(region, mr), 0) AS BIGINT) AS region,
       CAST(round_even(CAST(row_id % 4 AS DOUBLE) + 0.5, 0) AS BIGINT) AS half_even
FROM pnull, m""")
def q_round_codes(spark, sf):
    """I-12 mean fill of codes, then P-19 half-even rounding back to codes
    (x.5 cases included: half_even)."""
    from lacuna.functions.clean import round_half_even
    from lacuna.operators.impute import MeanImputer
    d = policy_nulls(spark, sf)
    f = MeanImputer(["seg", "nation", "region"]).fit(d).transform(d)
    return f.select("row_id", *[round_half_even(c).alias(c) for c in ("seg", "nation", "region")],
                    round_half_even((F.col("row_id") % 4).cast("double") + 0.5).alias("half_even"))


# ---------------------------------------------------------------- F-01..F-11

@query("factorize_sorted", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS type_code FROM part""")
def q_factorize(spark, sf):
    p = read_table(spark, sf, "part", ["p_partkey", "p_type"])
    return factorize(p, "p_type", "type_code").select("p_partkey", "type_code")


_VOCAB_TRAIN = f"{sql_uniform(42, 'vocab', 'o_orderkey')} < 0.5"


@query("vocab_apply_unseen", f"""
WITH v AS (SELECT o_custkey, CAST(row_number() OVER (ORDER BY o_custkey) AS BIGINT) AS idx
           FROM (SELECT DISTINCT o_custkey FROM orders WHERE {_VOCAB_TRAIN}))
SELECT o.o_orderkey AS row_id, coalesce(v.idx, 0) AS cust_idx FROM orders o LEFT JOIN v USING (o_custkey)""")
def q_vocab(spark, sf):
    """F-02 fit on a keyed half of orders, F-03 apply to all (unseen -> 0)."""
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    train = o.where(uniform(42, "vocab", "o_orderkey") < 0.5)
    vocab = fit_vocabulary(train, "o_custkey")
    return apply_vocabulary(o, vocab, "cust_idx").select(F.col("o_orderkey").alias("row_id"), "cust_idx")


_SPLIT_NULL = [NULLS_SQL, O.split_sql("pnull")]


@query("zscore_fit_apply", with_sql(*_SPLIT_NULL) + """
, m AS (SELECT avg(price) mp, stddev_pop(price) sp, avg(bal) mb, stddev_pop(bal) sb, avg(age) ma, stddev_pop(age) sa
        FROM split WHERE split = 'train')
SELECT row_id, round((price - mp) / CASE WHEN sp = 0 OR sp IS NULL THEN 1 ELSE sp END, 6) AS price,
       round((bal - mb) / CASE WHEN sb = 0 OR sb IS NULL THEN 1 ELSE sb END, 6) AS bal,
       round((age - ma) / CASE WHEN sa = 0 OR sa IS NULL THEN 1 ELSE sa END, 6) AS age
FROM split, m""")
def q_zscore(spark, sf):
    """F-04 fit on train (population std), F-05 apply to every split."""
    from lacuna.operators.sample import split_guaranteed
    s = split_guaranteed(policy_nulls(spark, sf), POLICY_SPEC, 0.7, 0.1, 42)
    z = ZScore.fit(s.where(F.col("split") == "train"), ["price", "bal", "age"])
    return s.select("row_id", *[r6(z.expr(c)).alias(c) for c in ("price", "bal", "age")])


_DENSE = POLICY_SPEC.dense


@query("minmax", with_sql(NULLS_SQL) + ", m AS (SELECT " + ", ".join(
    f"CAST(min(coalesce({c}, 0)) AS DOUBLE) AS lo_{c}, CAST(max(coalesce({c}, 0)) AS DOUBLE) AS hi_{c}" for c in _DENSE)
    + " FROM pnull),\nr AS (SELECT pnull.*, " + ", ".join(
    f"lo_{c}, CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END AS rg_{c}" for c in _DENSE)
    + " FROM pnull, m)\nSELECT row_id, " + ", ".join(
    f"round(({c} - lo_{c}) / rg_{c}, 6) AS {c}01, round((({c} - lo_{c}) / rg_{c}) * rg_{c} + lo_{c}, 4) AS {c}_back"
    for c in _DENSE) + " FROM r")
def q_minmax(spark, sf):
    """F-06: min-max of every dense column with NULL read as 0 at fit time,
    and its inverse."""
    d = policy_nulls(spark, sf)
    mm = MinMax.fit(d, list(_DENSE), null_as_zero=True)
    cols = []
    for c in _DENSE:
        s = mm.expr(c)
        cols += [r6(s).alias(f"{c}01"), F.round(mm.inverse(c, s), 4).alias(f"{c}_back")]
    return d.select("row_id", *cols)


@query("mean_fill_scale", with_sql(NULLS_SQL) + ", a AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}" for c in _DENSE) + " FROM pnull),\nf AS (SELECT row_id, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}, m_{c}" for c in _DENSE) + " FROM pnull, a),\nd AS (SELECT " + ", ".join(
    f"stddev_pop({c}) AS s_{c}" for c in _DENSE) + " FROM f)\nSELECT row_id, " + ", ".join(
    f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1 ELSE s_{c} END, 6) AS {c}_z" for c in _DENSE)
    + " FROM f, d")
def q_mean_fill_scale(spark, sf):
    """F-07 over every dense column: mean-fill, then z-score with the filled
    column's deviation -> missing reads 0."""
    d = policy_nulls(spark, sf)
    m = MeanFillScale.fit(d, list(_DENSE))
    return d.select("row_id", *[r6(m.expr(c)).alias(f"{c}_z") for c in _DENSE])


@query("missing_mask", with_sql(NULLS_SQL) + """
SELECT row_id, [CAST(seg IS NOT NULL AS INTEGER), CAST(nation IS NOT NULL AS INTEGER),
  CAST(region IS NOT NULL AS INTEGER), CAST(price IS NOT NULL AS INTEGER), CAST(bal IS NOT NULL AS INTEGER),
  CAST(age IS NOT NULL AS INTEGER)] AS mask FROM pnull""")
def q_missing_mask(spark, sf):
    """F-08."""
    return policy_nulls(spark, sf).select("row_id", missing_mask(FEATS).alias("mask"))


@query("uniform_bins", with_sql(NULLS_SQL) + ", m AS (SELECT " + ", ".join(
    f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _DENSE) + " FROM pnull)\nSELECT row_id, " + ", ".join(
    f"CAST(greatest(0, least(4, floor(({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END * 5))) "
    f"AS BIGINT) AS {c}_bin" for c in _DENSE) + " FROM pnull, m")
def q_uniform_bins(spark, sf):
    """F-09: 5 equal-width bins of every dense column (NULL stays NULL)."""
    d = policy_nulls(spark, sf)
    b = UniformBins.fit(d, list(_DENSE), 5)
    return d.select("row_id", *[b.expr(c).alias(f"{c}_bin") for c in _DENSE])


@query("snap_nearest", with_sql(*_SPLIT_NULL) + """
, tr AS (SELECT DISTINCT price AS v FROM split WHERE split = 'train' AND price IS NOT NULL),
te AS (SELECT row_id, price FROM split WHERE split <> 'train' AND price IS NOT NULL),
nb AS (SELECT row_id, price, (SELECT max(v) FROM tr WHERE v < price) AS lo,
              (SELECT min(v) FROM tr WHERE v >= price) AS hi FROM te)
SELECT row_id, price, CASE WHEN hi IS NULL THEN lo WHEN lo IS NULL THEN hi
                           WHEN price - lo < hi - price THEN lo ELSE hi END AS snapped FROM nb""")
def q_snap(spark, sf):
    """F-10: nearest train value (ties -> the larger), as a distributed
    as-of join in both directions."""
    from lacuna.operators.sample import split_guaranteed
    s = split_guaranteed(policy_nulls(spark, sf), POLICY_SPEC, 0.7, 0.1, 42).where(F.col("price").isNotNull())
    tr = s.where(F.col("split") == "train").select("price")
    te = s.where(F.col("split") != "train").select("row_id", "price")
    return nearest_value(te, tr, "price", "snapped").select("row_id", "price", "snapped")


@query("assemble_user", with_sql(POLICY_SQL) + """
SELECT row_id, [CAST(seg AS DOUBLE), CAST(nation AS DOUBLE), CAST(region AS DOUBLE), price, bal,
  CAST(age AS DOUBLE)] AS user_vec FROM policy""")
def q_assemble(spark, sf):
    """F-11: sparse ++ dense."""
    return policy(spark, sf).select("row_id", assemble(FEATS).alias("user_vec"))


# ---------------------------------------------------------------- A-01..A-05

@query("class_counts", with_sql(POLICY_SQL) + """
SELECT product_item, count(*) AS n FROM policy GROUP BY product_item""")
def q_class_counts(spark, sf):
    return S.class_counts(policy(spark, sf), "product_item")


@query("column_profile", with_sql(NULLS_SQL) + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(*) AS n_rows, CAST(max({c}) AS DOUBLE) AS max, CAST(min({c}) AS DOUBLE) AS min, "
    f"count(DISTINCT {c}) AS nunique FROM pnull" for c in FEATS + ["product_item"]))
def q_column_profile(spark, sf):
    return S.column_profile(policy_nulls(spark, sf), FEATS + ["product_item"])


@query("missing_pct", with_sql(NULLS_SQL) + "\nSELECT round(CAST(" + " + ".join(
    f"count(*) - count({c})" for c in FEATS + ["product_item"]) + f" AS DOUBLE) / (count(*) * {len(FEATS) + 1}) * 100, 6)"
    " AS missing_pct FROM pnull")
def q_missing_pct(spark, sf):
    d = policy_nulls(spark, sf)
    return S.missing_pct(d, FEATS + ["product_item"]).select(r6("missing_pct").alias("missing_pct"))


@query("min_max", with_sql(NULLS_SQL) + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM pnull"
    for c in FEATS))
def q_min_max(spark, sf):
    return S.min_max(policy_nulls(spark, sf), FEATS)


@query("class_distinct", with_sql(POLICY_SQL) + """
SELECT count(DISTINCT product_item) AS n_classes FROM policy""")
def q_class_distinct(spark, sf):
    return policy(spark, sf).agg(F.countDistinct("product_item").alias("n_classes"))
