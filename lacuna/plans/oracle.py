"""DuckDB text builders for the oracle side of the registered queries.

These write the plain single-node SQL of each operator (windows over all
rows are fine there: the oracle only checks results at small scale).
"""

from __future__ import annotations

import math

from lacuna.functions.draws import sql_uniform
from lacuna.spec import FeatureSpec


def rare_filter_sql(src: str, item: str = "product_item", min_count: int = 3, name: str = "filt",
                    cols: str = "row_id, seg, nation, region, price, bal, age") -> str:
    return f"""{name} AS (
  SELECT {cols}, CAST(dense_rank() OVER (ORDER BY {item}) - 1 AS BIGINT) AS {item}
  FROM {src}
  WHERE {item} IN (SELECT {item} FROM {src} WHERE {item} IS NOT NULL GROUP BY {item} HAVING count(*) >= {min_count}))"""


def split_sql(src: str, item: str = "product_item", seed: int = 42, tr: float = 0.7, va: float = 0.1,
              row_id: str = "row_id", name: str = "split") -> str:
    u = sql_uniform(seed, "shuffle", row_id)
    return f"""{name}_cc AS (
  SELECT *, row_number() OVER (PARTITION BY {item} ORDER BY _u, {row_id}) - 1 AS _cc
  FROM (SELECT *, {u} AS _u FROM {src})),
{name}_tot AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE _cc = 0) AS n0, count(*) FILTER (WHERE _cc = 1) AS n1
  FROM {name}_cc),
{name}_lim AS (
  SELECT greatest(0, CAST(floor(n * CAST({tr!r} AS DOUBLE)) AS BIGINT) - n0) AS nt,
         greatest(0, CAST(floor(n * CAST({va!r} AS DOUBLE)) AS BIGINT) - n1) AS nv FROM {name}_tot),
{name}_rest AS (
  SELECT {row_id}, row_number() OVER (ORDER BY _u, {row_id}) - 1 AS _r FROM {name}_cc WHERE _cc > 2),
{name} AS (
  SELECT c.* EXCLUDE (_u, _cc, _r),
         CASE WHEN _cc = 0 THEN 'train' WHEN _cc = 1 THEN 'valid' WHEN _cc = 2 THEN 'test'
              WHEN _r < nt THEN 'train' WHEN _r < nt + nv THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT * FROM {name}_cc LEFT JOIN {name}_rest USING ({row_id})) c CROSS JOIN {name}_lim)"""


def zscore_sql(src: str, spec: FeatureSpec, name: str = "z", fit_where: str = "split = 'train'") -> str:
    """Adds x_<feature> columns: sparse raw (double), dense standardised on
    the rows matching ``fit_where`` (population std, 0 -> 1)."""
    mom = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in spec.dense)
    xs = [f"CAST({c} AS DOUBLE) AS x_{c}" for c in spec.sparse]
    xs += [f"({c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1 ELSE s_{c} END AS x_{c}"
           for c in spec.dense]
    return f"""{name}_mom AS (SELECT {mom} FROM {src} WHERE {fit_where}),
{name} AS (SELECT t.*, {', '.join(xs)} FROM {src} t CROSS JOIN {name}_mom)"""


def nb_proba_sql(src: str, spec: FeatureSpec, name: str = "nbp", var_smoothing: float = 1e-9,
                 fit_where: str = "split = 'train'", score_where: str = "split = 'test'") -> str:
    """Long probabilities (row_id, y, cid, p) of Gaussian NB fitted on
    ``fit_where`` rows of ``src`` (which carries x_<feature> columns)."""
    f = spec.features
    item = spec.item
    eps = f"{var_smoothing!r} * greatest({', '.join(f'var_pop(x_{c})' for c in f)})" if len(f) > 1 \
        else f"{var_smoothing!r} * var_pop(x_{f[0]})"
    stats = ", ".join(f"avg(x_{c}) AS m_{c}, var_pop(x_{c}) AS v_{c}" for c in f)
    ll = " + ".join(f"ln({2 * math.pi!r} * (v_{c} + eps)) + (t.x_{c} - m_{c}) * (t.x_{c} - m_{c}) / (v_{c} + eps)"
                    for c in f)
    return f"""{name}_eps AS (SELECT {eps} AS eps, count(*) AS ntr FROM {src} WHERE {fit_where}),
{name}_cls AS (SELECT {item} AS cid, count(*) AS nc, {stats} FROM {src} WHERE {fit_where} GROUP BY {item}),
{name}_jll AS (
  SELECT t.row_id, t.{item} AS y, c.cid, ln(c.nc / e.ntr) - 0.5 * ({ll}) AS l
  FROM (SELECT * FROM {src} WHERE {score_where}) t CROSS JOIN {name}_cls c CROSS JOIN {name}_eps e),
{name}_mx AS (SELECT *, exp(l - max(l) OVER (PARTITION BY row_id)) AS e FROM {name}_jll),
{name} AS (SELECT row_id, y, cid, e / sum(e) OVER (PARTITION BY row_id) AS p FROM {name}_mx)"""


def topk_sql(src: str, name: str = "rk") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, cid) AS rnk FROM {src})"""


def auc_sql(src: str, name: str = "aucc") -> str:
    """Per-class OvR AUC from long (row_id, y, cid, p): ties count 1/2."""
    return f"""{name}_g AS (
  SELECT cid, p, sum(CASE WHEN y = cid THEN 1 ELSE 0 END) AS npos, sum(CASE WHEN y = cid THEN 0 ELSE 1 END) AS nneg
  FROM {src} GROUP BY cid, p),
{name}_w AS (
  SELECT *, coalesce(sum(nneg) OVER (PARTITION BY cid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     0) AS nb FROM {name}_g),
{name} AS (
  SELECT cid AS class_id,
         CASE WHEN sum(npos) > 0 AND sum(nneg) > 0
              THEN sum(npos * nb + 0.5 * npos * nneg) / (sum(npos) * sum(nneg)) END AS auc
  FROM {name}_w GROUP BY cid)"""
