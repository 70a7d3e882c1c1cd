"""Fixture tables built from the given parquet tables (FIXTURES.md §2-§3),
each with its DuckDB text so the oracle can rebuild the same rows.

``policy``: orders x customer x nation, one row per order.
``policy_planted``: same rows with a planted premium and a learnable target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.draws import sql_uniform, uniform
from lacuna.operators.dictionary import factorize
from lacuna.operators.rank import join_small
from lacuna.session import cut_lineage
from lacuna.sources.tables import read_table
from lacuna.spec import FeatureSpec

POLICY_SPEC = FeatureSpec(item="product_item", sparse=("seg", "nation", "region"),
                          dense=("price", "bal", "age"), row_id="row_id")
PLANTED_SPEC = FeatureSpec(item="product_item", sparse=("seg", "nation", "region"),
                           dense=("price", "bal", "age", "premium"), row_id="row_id")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                             "o_orderdate", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    oc = o.join(c, o.o_custkey == c.c_custkey)          # both sides grow: shuffle/AQE join
    return join_small(oc, n, oc.c_nationkey == n.n_nationkey)  # nation: size-checked broadcast


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _joined(spark, sf_dir).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("c_mktsegment").alias("seg"),
        F.col("c_nationkey").cast("long").alias("nation"),
        F.col("n_regionkey").cast("long").alias("region"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("bal"),
        (F.lit(2002) - F.year("o_orderdate")).cast("long").alias("age"),
        F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("product_item"))
    # each fit reads its own column only; nothing is staged but the dictionaries
    j = factorize(j, "seg")
    j = factorize(j, "product_item")
    return j.select("row_id", "seg", "nation", "region", "price", "bal", "age", "product_item")


def policy_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy(spark, sf_dir)
    prem = F.lit(0.1) * F.col("price") + F.lit(20000.0) * (uniform(42, "premium", "row_id") - F.lit(0.5))
    tgt = (F.lit(2) * (F.col("price") > 250000).cast("long") + (F.col("bal") > 4500).cast("long"))
    return p.select("row_id", "seg", "nation", "region", "price", "bal", "age",
                    prem.alias("premium"), tgt.cast("long").alias("product_item"))


# ---- DuckDB text ------------------------------------------------------------

POLICY_SQL = """
policy AS (
  SELECT o.o_orderkey AS row_id,
         CAST(dense_rank() OVER (ORDER BY c.c_mktsegment) - 1 AS BIGINT) AS seg,
         CAST(c.c_nationkey AS BIGINT) AS nation,
         CAST(n.n_regionkey AS BIGINT) AS region,
         o.o_totalprice AS price,
         c.c_acctbal AS bal,
         CAST(2002 - year(o.o_orderdate) AS BIGINT) AS age,
         CAST(dense_rank() OVER (ORDER BY concat_ws('|', o.o_orderpriority, o.o_orderstatus)) - 1 AS BIGINT)
           AS product_item
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

PLANTED_SQL = POLICY_SQL + f""",
planted AS (
  SELECT row_id, seg, nation, region, price, bal, age,
         0.1 * price + 20000.0 * ({sql_uniform(42, 'premium', 'row_id')} - 0.5) AS premium,
         CAST(2 * CAST(price > 250000 AS BIGINT) + CAST(bal > 4500 AS BIGINT) AS BIGINT) AS product_item
  FROM policy)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


# ---- policy with injected missing cells (T-05, ratio 0.2, seed 7) ---------
NULL_RATIO, NULL_SEED = 0.2, 7


def policy_nulls(spark: SparkSession, sf_dir: str, planted: bool = False) -> DataFrame:
    from lacuna.operators.missing import inject_missing
    base = policy_planted(spark, sf_dir) if planted else policy(spark, sf_dir)
    spec = PLANTED_SPEC if planted else POLICY_SPEC
    return cut_lineage(inject_missing(base, spec, NULL_RATIO, NULL_SEED, "random"))


def sql_mask_random(src: str, spec: FeatureSpec, ratio: float, seed: int, name: str) -> str:
    cols = []
    for c in spec.features:
        u = sql_uniform(seed, f"miss|{c}", "row_id")
        cols.append(f"CASE WHEN {c} IS NOT NULL AND row_number() OVER (PARTITION BY {c} IS NULL ORDER BY {u}, row_id)"
                    f" <= floor(count({c}) OVER () * CAST({ratio!r} AS DOUBLE)) THEN NULL ELSE {c} END AS {c}")
    return f"{name} AS (SELECT row_id, {', '.join(cols)}, {spec.item} FROM {src})"


NULLS_SQL = POLICY_SQL + ",\n" + sql_mask_random("policy", POLICY_SPEC, NULL_RATIO, NULL_SEED, "pnull")
PLANTED_NULLS_SQL = PLANTED_SQL + ",\n" + sql_mask_random("planted", PLANTED_SPEC, NULL_RATIO, NULL_SEED, "pnull")
