"""Contrastive losses and field-interaction operators on ``embeddings``
(M-18, M-19, F-13..F-15), field embeddings (F-12) and view perturbations on ``policy`` (F-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.draws import sql_uniform, uniform
from lacuna.functions import interactions as I
from lacuna.operators.contrastive import batch_losses, with_batches
from lacuna.operators.fields import field_embed
from lacuna.operators.missing import py_uniform
from lacuna.plans.registry import query, r6
from lacuna.sources.fixtures import POLICY_SPEC, POLICY_SQL, policy, with_sql
from lacuna.sources.tables import read_table

NOISE = 0.1


def views(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    e = e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v0"))
    noise = F.transform("v0", lambda x, i: x + F.lit(NOISE) * (
        uniform(42, "view", F.concat_ws("|", F.col("vec_id").cast("string"), i.cast("string"))) - F.lit(0.5)))
    return with_batches(e.withColumn("v1", noise), "vec_id", 256, 42)


def _u_sql(key: str) -> str:
    return (f"(('0x' || substr(md5(concat_ws('|', '42', 'view', {key})), 1, 13))::BIGINT / 4503599627370496.0)")


_VIEWS_SQL = f"""
WITH nbt AS (SELECT CAST(ceil(count(*) / 256.0) AS BIGINT) AS nb FROM embeddings),
base AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v0,
         list_transform(CAST(embedding AS DOUBLE[]),
           lambda x, i: x + {NOISE!r} * ({_u_sql("CAST(vec_id AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR)")} - 0.5)) AS v1,
         CAST(floor((('0x' || substr(md5(concat_ws('|', '42', 'batch', CAST(vec_id AS VARCHAR))), 1, 13))::BIGINT
               / 4503599627370496.0) * nb) AS BIGINT) AS batch_id
  FROM embeddings, nbt),
wv AS (
  SELECT *, exp(-list_sum(list_transform(list_zip(v0, v1), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) / 2.0 / 128.0) AS ew
  FROM base),
wn AS (SELECT *, ew / (avg(ew) OVER (PARTITION BY batch_id) + 1e-8) AS w FROM wv),
rows AS (
  SELECT batch_id, vec_id, 0 AS view, label, w,
         list_transform(v0, lambda x: x / greatest(sqrt(list_sum(list_transform(v0, lambda y: y * y))), 1e-12)) AS f FROM wn
  UNION ALL
  SELECT batch_id, vec_id, 1, label, w,
         list_transform(v1, lambda x: x / greatest(sqrt(list_sum(list_transform(v1, lambda y: y * y))), 1e-12)) FROM wn),
pairs AS (
  SELECT a.batch_id, a.vec_id AS av, a.view AS aw, b.vec_id AS bv, b.view AS bw, a.label = b.label AS same,
         (a.vec_id = b.vec_id AND a.view = b.view) AS self, a.w * b.w AS ww,
         list_dot_product(a.f, b.f) / 0.1 AS sim
  FROM rows a JOIN rows b ON a.batch_id = b.batch_id),
lg AS (SELECT *, sim - max(sim) OVER (PARTITION BY batch_id, av, aw) AS l FROM pairs),
wt AS (SELECT *, l + ln(ww + 1e-8) AS wl FROM lg),
den AS (
  SELECT *, sum(CASE WHEN self THEN 0 ELSE exp(wl) END) OVER (PARTITION BY batch_id, av, aw) AS dw,
            sum(CASE WHEN self THEN 0 ELSE exp(l) END) OVER (PARTITION BY batch_id, av, aw) AS ds FROM wt),
anc AS (
  SELECT batch_id, av, aw,
         sum(CASE WHEN same THEN wl - ln(dw + 1e-8) ELSE 0 END) / greatest(sum(CASE WHEN same THEN 1 ELSE 0 END), 1e-8)
           AS mw,
         sum(CASE WHEN same AND NOT self THEN l - ln(ds + 1e-8) ELSE 0 END)
           / (sum(CASE WHEN same AND NOT self THEN 1 ELSE 0 END) + 1e-8) AS ms
  FROM den GROUP BY batch_id, av, aw)
"""


@query("supcon_batches", _VIEWS_SQL + """
SELECT batch_id, CAST(count(*) / 2 AS BIGINT) AS n, round(-avg(mw), 6) AS loss_weighted,
       round(-avg(ms), 6) AS loss_standard FROM anc GROUP BY batch_id""")
def q_supcon(spark, sf):
    """M-18 (variance-weighted, self kept as positive) and M-19 (standard)
    per keyed batch; two views: the vector and vector + keyed noise."""
    b = batch_losses(views(spark, sf), ["v0", "v1"], "label", 0.1)
    return b.select("batch_id", "n", r6(F.col("loss_weighted")).alias("loss_weighted"),
                    r6(F.col("loss_standard")).alias("loss_standard"))


@query("fm_pairs", """
SELECT vec_id, round(0.5 * list_sum(list_transform(range(8), lambda d:
    power(list_sum(list_transform(range(8), lambda f: CAST(embedding[f * 8 + d + 1] AS DOUBLE))), 2)
    - list_sum(list_transform(range(8), lambda f: power(CAST(embedding[f * 8 + d + 1] AS DOUBLE), 2))))), 4) AS fm
FROM embeddings""")
def q_fm(spark, sf):
    """F-13: factorization-machine pair pooling over 8 fields x 8 dims."""
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return e.select("vec_id", F.round(I.fm_pairs(F.col("embedding"), 8, 8), 4).alias("fm"))


_W = I.cross_weights(64, 2)


@query("cross_layer", "SELECT vec_id, round(list_sum(" + I.cross_sql("CAST(embedding AS DOUBLE[])", _W)
       + "), 4) AS cross_sum FROM embeddings")
def q_cross(spark, sf):
    """F-14: two cross layers x_{l+1} = x0 * (x_l . w_l) + b_l + x_l with
    fixed keyed weights; the sum of the output vector."""
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    x = I.cross_layers(F.transform("embedding", lambda v: v.cast("double")), _W)
    return e.select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 4).alias("cross_sum"))


def _matrix(name: str) -> list:
    return [[py_uniform(7, name, f"{r}|{c}") - 0.5 for c in range(8)] for r in range(8)]


_SHARED, _EACH = [_matrix("pair")], [_matrix(f"pair{f}") for f in range(8)]


def _columns_sql(matrices) -> str:
    """Matrices as lists of their columns."""
    return "[" + ", ".join("[" + ", ".join("[" + ", ".join(repr(m[r][c]) for r in range(8)) + "]" for c in range(8)) + "]"
                           for m in matrices) + "]::DOUBLE[][][]"


_PAIR_SQL = " UNION ALL ".join(
    f"SELECT vec_id, '{kind}' AS kind, i AS field_i, j AS field_j, " + ", ".join(
        f"round(list_dot_product(e[i * 8 + 1:i * 8 + 8], {w}[{at}][{d + 1}]) * e[j * 8 + {d + 1}], 6) AS p{d}" for d in range(8))
    + " FROM x, fi, fj, w WHERE i < j" for kind, w, at in (("shared", "ws", "1"), ("each", "we", "i + 1")))


@query("bilinear_pairs", f"""
WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64),
fi AS (SELECT CAST(range AS INTEGER) AS i FROM range(8)), fj AS (SELECT CAST(range AS INTEGER) AS j FROM range(8)),
w AS (SELECT {_columns_sql(_SHARED)} AS ws, {_columns_sql(_EACH)} AS we)
""" + _PAIR_SQL)
def q_bilinear(spark, sf):
    """F-15: bilinear pairs of 8 fields x 8 dims by one shared matrix and by
    one for each field, a row for each pair of fields."""
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    blocks = lambda w: F.transform(F.sequence(F.lit(0), F.lit(27)), lambda t: F.slice(w, t * 8 + 1, 8))
    both = e.select("vec_id", I.bilinear_pairs(F.col("embedding"), 8, 8, _SHARED).alias("shared"),
                    I.bilinear_pairs(F.col("embedding"), 8, 8, _EACH).alias("each"))
    kinds = both.select("vec_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v"))
                                                      for k in ("shared", "each")])).alias("k"))
    rows = kinds.where("k.v IS NOT NULL").select("vec_id", "k.kind", F.posexplode(blocks(F.col("k.v"))).alias("at", "v"))
    name = lambda side: F.element_at(F.array(*[F.lit(p[side]) for p in I.pair_fields(8)]), F.col("at") + 1)
    return rows.select("vec_id", "kind", name(0).alias("field_i"), name(1).alias("field_j"),
                       *[r6(F.col("v")[d]).alias(f"p{d}") for d in range(8)])


_DIM = 4
_LINES = {c: ([py_uniform(9, f"w|{c}", d) - 0.5 for d in range(_DIM)], [py_uniform(9, f"b|{c}", d) - 0.5 for d in range(_DIM)])
          for c in POLICY_SPEC.dense}


def _embed_sql() -> str:
    key = lambda c, d: f"concat_ws('|', '{c}', CAST({c} AS VARCHAR), '{d}')"
    cells = [f"{sql_uniform(9, 'embed', key(c, d))} - 0.5" for c in POLICY_SPEC.sparse for d in range(_DIM)]
    cells += [f"{w!r}::DOUBLE * {c} + {b!r}::DOUBLE" for c in POLICY_SPEC.dense for w, b in zip(*_LINES[c])]
    return with_sql(POLICY_SQL) + "\nSELECT row_id, " + ", ".join(f"round({v}, 4) AS e{k}" for k, v in enumerate(cells)) + " FROM policy"


@query("field_embed", _embed_sql())
def q_field_embed(spark, sf):
    """F-12: three sparse and three dense fields of four components each; the
    table holds a keyed vector for each code that occurs."""
    p = policy(spark, sf)
    codes = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("code"))
                                         for c in POLICY_SPEC.sparse])).alias("e")).select("e.*").distinct()
    table = codes.select("field", "code", F.array(*[uniform(9, "embed", F.concat_ws("|", "field", F.col("code").cast("string"), F.lit(str(d))))
                                                    - F.lit(0.5) for d in range(_DIM)]).alias("vector"))
    x = field_embed(p, table, POLICY_SPEC.sparse, POLICY_SPEC.dense, _LINES, _DIM)
    n = _DIM * len(POLICY_SPEC.features)
    return x.select("row_id", *[F.round(F.col("fields")[k], 4).alias(f"e{k}") for k in range(n)])


# ---------------------------------------------------------------- F-16

FEATS = POLICY_SPEC.features


@query("perturb_random", with_sql(POLICY_SQL) + "\nSELECT row_id, " + ", ".join(
    f"CASE WHEN (('0x' || substr(md5(concat_ws('|', '42', 'keep|{c}', CAST(row_id AS VARCHAR))), 1, 13))::BIGINT"
    f" / 4503599627370496.0) < 0.7 THEN CAST({c} AS DOUBLE) ELSE 0.0 END AS {c}" for c in FEATS) + " FROM policy")
def q_perturb_random(spark, sf):
    """F-16 random: keep each cell with probability 1 - r (r = 0.3), else 0."""
    p = policy(spark, sf)
    return p.select("row_id", *[I.perturb_random(c, 0.3, 42).alias(c) for c in FEATS])


@query("perturb_noise", with_sql(POLICY_SQL) + "\nSELECT row_id, " + ", ".join(
    [f"CAST({c} AS DOUBLE) AS {c}" for c in POLICY_SPEC.sparse]
    + [f"round({c} + 0.1 * (2 * (('0x' || substr(md5(concat_ws('|', '42', 'noise|{c}', CAST(row_id AS VARCHAR))), 1,"
       f" 13))::BIGINT / 4503599627370496.0) - 1), 6) AS {c}" for c in POLICY_SPEC.dense]) + " FROM policy")
def q_perturb_noise(spark, sf):
    """F-16 noise: add U(-r, r) (r = 0.1) to dense features only."""
    p = policy(spark, sf)
    return p.select("row_id", *[F.col(c).cast("double").alias(c) for c in POLICY_SPEC.sparse],
                    *[r6(I.perturb_noise(c, 0.1, 42)).alias(c) for c in POLICY_SPEC.dense])


def _feature_sql():
    k = max(1, int(len(FEATS) * 0.3))
    rank = ("row_number() OVER (PARTITION BY b ORDER BY (('0x' || substr(md5(concat_ws('|', '42', 'feat', "
            "CAST(b AS VARCHAR) || '|' || name)), 1, 13))::BIGINT / 4503599627370496.0), name)")
    names = " UNION ALL ".join(f"SELECT '{c}' AS name" for c in FEATS)
    sel = ", ".join(f"CASE WHEN '{c}' IN (SELECT name FROM ch WHERE ch.b = pb.b) THEN 0.0 ELSE CAST({c} AS DOUBLE)"
                    f" END AS {c}" for c in FEATS)
    return with_sql(POLICY_SQL) + f"""
, pb AS (SELECT *, CAST(floor((('0x' || substr(md5(concat_ws('|', '42', 'batch', CAST(row_id AS VARCHAR))), 1, 13))
          ::BIGINT / 4503599627370496.0) * 16) AS BIGINT) AS b FROM policy),
nm AS ({names}),
ch AS (SELECT b, name FROM (SELECT bs.b, nm.name, {rank} AS rk FROM (SELECT DISTINCT b FROM pb) bs, nm) WHERE rk <= {k})
SELECT row_id, {sel} FROM pb"""


@query("perturb_feature", _feature_sql())
def q_perturb_feature(spark, sf):
    """F-16 feature: per batch (16 keyed batches) zero max(1, floor(p r))
    columns chosen by a keyed draw on (batch, column)."""
    p = policy(spark, sf).withColumn("b", F.floor(uniform(42, "batch", "row_id") * 16).cast("long"))
    return p.select("row_id", *I.perturb_feature(FEATS, 0.3, 42, "b"))
