"""Recommenders and imputers on the planted policy table (M-02, M-04,
M-21, M-22, I-05, I-10, I-12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lacuna.models.ensemble import Augment, Ensemble
from lacuna.models.knn import KNNRecommender
from lacuna.models.registry import recommender
from lacuna.operators import metrics as M
from lacuna.operators.ranking import proba_long
from lacuna.operators.sample import split_guaranteed
from lacuna.plans import oracle as O
from lacuna.plans.registry import query, r6
from lacuna.session import cut_lineage
from lacuna.sources.fixtures import (NULL_RATIO, PLANTED_SPEC, PLANTED_SQL, policy_nulls, policy_planted,
                                     sql_mask_random, with_sql)

SPEC = PLANTED_SPEC
FEATS = SPEC.features
COLS = "row_id, " + ", ".join(FEATS) + ", product_item"


def planted_split(spark, sf, nulls: bool = False):
    base = policy_nulls(spark, sf, planted=True) if nulls else policy_planted(spark, sf)
    return cut_lineage(split_guaranteed(base, SPEC, 0.7, 0.1, 42))


_PSPLIT = [PLANTED_SQL, O.split_sql("planted")]


def _d2_sql(a: str, b: str, cols, nan_aware: bool) -> tuple[str, str]:
    if not nan_aware:
        return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in cols), ""
    acc = " + ".join(f"CASE WHEN {a}.{c} IS NOT NULL AND {b}.{c} IS NOT NULL THEN ({a}.{c} - {b}.{c}) * "
                     f"({a}.{c} - {b}.{c}) ELSE 0.0 END" for c in cols)
    pres = " + ".join(f"CASE WHEN {a}.{c} IS NOT NULL AND {b}.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols)
    return acc, pres


_ZX = [f"x_{c}" for c in FEATS]
_KNN_D2, _ = _d2_sql("q", "d", _ZX, False)


@query("knn_proba", with_sql(*_PSPLIT, O.zscore_sql("split", SPEC)) + f"""
, pairs AS (SELECT q.row_id AS qid, d.row_id AS did, d.product_item AS dy, {_KNN_D2} AS d2
            FROM (SELECT * FROM z WHERE split = 'test') q, (SELECT * FROM z WHERE split = 'train') d),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, did) AS rn FROM pairs) WHERE rn <= 10),
nb AS (SELECT *, max(CASE WHEN d2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS hz FROM rk),
v AS (SELECT qid, dy, sum(CASE WHEN hz = 1 THEN CAST(d2 = 0 AS DOUBLE) ELSE 1.0 / sqrt(d2) END) AS s
      FROM nb GROUP BY qid, dy)
SELECT qid AS row_id, dy AS class_id, round(s / sum(s) OVER (PARTITION BY qid), 6) AS proba FROM v WHERE s > 0""")
def q_knn_proba(spark, sf):
    """M-04: class probabilities of the 10-NN distance-weighted vote."""
    s = planted_split(spark, sf)
    m = KNNRecommender(SPEC, k=3).fit(s.where(F.col("split") == "train"))
    p = m.proba(s.where(F.col("split") == "test"))
    return proba_long(p).where(F.col("proba") > 0).select("row_id", "class_id", r6(F.col("proba")).alias("proba"))


_ACC, _PRES = _d2_sql("q", "d", FEATS, True)
_P = len(FEATS)
PLANTED_NULLS_SQL = PLANTED_SQL + ",\n" + sql_mask_random("planted", SPEC, NULL_RATIO, 7, "pnull")


def _rounded(c: str, x: str) -> str:
    """Codes are rounded half to even after imputation, the rest to 6 places."""
    return f"round_even({x}, 0)" if c in SPEC.sparse else f"round({x}, 6)"


_KNN_IMP_SQL = with_sql(PLANTED_NULLS_SQL, O.split_sql("pnull")) + f"""
, q AS (SELECT * FROM split WHERE {' OR '.join(f'{c} IS NULL' for c in FEATS)}),
d AS (SELECT * FROM split WHERE split = 'train'),
pr AS (SELECT q.row_id AS qid, d.row_id AS did,
              CASE WHEN ({_PRES}) > 0 THEN (CAST({_P} AS DOUBLE) / ({_PRES})) * ({_ACC}) END AS d2,
              {', '.join(f'd.{c} AS v_{c}' for c in FEATS)} FROM q, d),
f AS (SELECT qid, {', '.join(
    f"list_avg(list_transform(min(row(d2, did, CAST(v_{c} AS DOUBLE)), 5) FILTER (WHERE v_{c} IS NOT NULL AND d2 IS NOT NULL), "
    f"lambda x: x[3])) AS f_{c}" for c in FEATS)}
      FROM pr GROUP BY qid),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in FEATS)} FROM d)
SELECT s.row_id, s.split, {', '.join(_rounded(c, f'coalesce(CAST(s.{c} AS DOUBLE), f_{c}, m_{c})') + f' AS {c}' for c in FEATS)}
FROM split s LEFT JOIN f ON f.qid = s.row_id CROSS JOIN m"""


def _named(df, *keys):
    return df.select(*keys, *[(F.col(c) if c in SPEC.sparse else r6(F.col(c))).alias(c) for c in FEATS])


def _imputed(spark, sf, name: str, rounds: int = 10):
    """I-10: an imputer fitted on train fills train, valid and test."""
    from lacuna.operators.mice import imputer
    s = planted_split(spark, sf, nulls=True)
    imp = imputer(name, FEATS, codes=tuple(SPEC.sparse), rounds=rounds)
    imp.fit(s.where(F.col("split") == "train").select("row_id", *FEATS))
    return _named(imp.transform(s.select("row_id", "split", *FEATS)), "row_id", "split")


@query("impute_knn", _KNN_IMP_SQL)
def q_impute_knn(spark, sf):
    """I-05 + I-10: mean of the 5 nearest train donors having the column
    (nan-Euclidean), else the train mean; every split is filled."""
    return _imputed(spark, sf, "knn")


@query("impute_mean", with_sql(PLANTED_NULLS_SQL, O.split_sql("pnull")) + f"""
, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in FEATS)} FROM split WHERE split = 'train')
SELECT row_id, split, {', '.join(_rounded(c, f'coalesce(CAST({c} AS DOUBLE), m_{c})') + f' AS {c}' for c in FEATS)}
FROM split, m""")
def q_impute_mean(spark, sf):
    """I-12 + I-10: train means fill every split."""
    return _imputed(spark, sf, "mean")


@query("class_weights", with_sql(*_PSPLIT) + """
, c AS (SELECT product_item, count(*) AS n FROM split WHERE split = 'train' GROUP BY product_item)
SELECT product_item, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c""")
def q_class_weights(spark, sf):
    """M-02 'balanced' weights n / (K * n_c) on the train split."""
    from lacuna.models.linear import balanced_weights
    s = planted_split(spark, sf).where(F.col("split") == "train")
    return balanced_weights(s, "product_item").select("product_item", "n", r6(F.col("weight")).alias("weight"))


# ---- ensembles: members differ by imputer and see all rows
_MEMBERS = ("mean", "knn")


def _member_ctes():
    """The split with missing cells, filled by each member's imputer."""
    keep = "row_id, split, product_item, "
    mean = ", ".join(_rounded(c, f"coalesce(CAST(s.{c} AS DOUBLE), m_{c})") + f" AS {c}" for c in FEATS)
    knn = ", ".join(_rounded(c, f"coalesce(CAST(s.{c} AS DOUBLE), f_{c}, m_{c})") + f" AS {c}" for c in FEATS)
    body = _KNN_IMP_SQL[len("WITH "):_KNN_IMP_SQL.rindex("SELECT s.row_id")].rstrip()
    return [body, f"filled_mean AS (SELECT s.{keep}{mean} FROM split s CROSS JOIN m)",
            f"filled_knn AS (SELECT s.{keep}{knn} FROM split s LEFT JOIN f ON f.qid = s.row_id CROSS JOIN m)"]


def _ensemble_sql():
    ctes = _member_ctes()
    for x in _MEMBERS:
        ctes += [O.zscore_sql(f"filled_{x}", SPEC, name=f"z_{x}"), O.nb_proba_sql(f"z_{x}", SPEC, name=f"nb_{x}")]
    return with_sql(*ctes) + "\nSELECT row_id, cid AS class_id, round(avg(p), 6) AS proba FROM (" + " UNION ALL ".join(
        f"SELECT row_id, cid, p FROM nb_{x}" for x in _MEMBERS) + ") GROUP BY row_id, cid"


@query("ensemble_average", _ensemble_sql())
def q_ensemble(spark, sf):
    """M-21: members with an imputer of their own, fitted on all train rows;
    their probabilities are averaged by row and class."""
    s = planted_split(spark, sf, nulls=True)
    m = Ensemble(SPEC, views=_MEMBERS, backbone="NB").fit(s.where("split = 'train'"))
    return proba_long(m.proba(s.where("split = 'test'"))).select("row_id", "class_id", r6(F.col("proba")).alias("proba"))


def _augment_sql():
    both = " UNION ALL ".join(f"SELECT * FROM filled_{x} WHERE split = 'train'" for x in _MEMBERS)
    ctes = _member_ctes() + [f"aug AS ({both} UNION ALL SELECT * FROM filled_mean WHERE split = 'test')",
                             O.zscore_sql("aug", SPEC), O.nb_proba_sql("z", SPEC)]
    return with_sql(*ctes) + "\nSELECT row_id, cid AS class_id, round(p, 4) AS proba FROM nbp"


@query("augment_union", _augment_sql())
def q_augment(spark, sf):
    """M-22: the completions of one train table stacked as training rows of
    one model; test rows are filled by the first imputer."""
    s = planted_split(spark, sf, nulls=True)
    m = Augment(SPEC, views=_MEMBERS, backbone="NB").fit(s.where("split = 'train'"))
    return proba_long(m.proba(s.where("split = 'test'"))).select(
        "row_id", "class_id", F.round("proba", 4).alias("proba"))


def _fit_score(spark, sf, model):
    s = planted_split(spark, sf)
    m = model.fit(s.where(F.col("split") == "train"))
    p = m.proba(s.where(F.col("split") == "test"))
    return proba_long(p).select("row_id", "class_id", r6(F.col("proba")).alias("proba"))


@query("rec_lr")
def q_rec_lr(spark, sf):
    """M-02 multinomial LR with balanced weights and its default 1000
    iterations at most (rows-only check; tested against the class prior)."""
    return _fit_score(spark, sf, recommender("LR", SPEC))


@query("rec_rf")
def q_rec_rf(spark, sf):
    """M-06 random forest of 100 trees, depth 8."""
    return _fit_score(spark, sf, recommender("RF", SPEC, n_estimators=100, max_depth=8))


@query("rec_gbt")
def q_rec_gbt(spark, sf):
    """M-07 one-vs-rest boosted trees (the preset: 100 rounds of depth 6)."""
    return _fit_score(spark, sf, recommender("XGB", SPEC))


@query("rec_lgbm")
def q_rec_lgbm(spark, sf):
    """M-08 (the preset: 100 rounds)."""
    return _fit_score(spark, sf, recommender("LGBM", SPEC))


@query("rec_catb")
def q_rec_catb(spark, sf):
    """M-09 with nominal sparse features (the preset: 200 rounds of depth 6)."""
    return _fit_score(spark, sf, recommender("CatB", SPEC))


@query("rec_bn")
def q_rec_bn(spark, sf):
    """M-05 tree-augmented Bayes net over binned features."""
    return _fit_score(spark, sf, recommender("BN", SPEC))


@query("bn_cmi", with_sql(*_PSPLIT) + """
, b AS (SELECT product_item AS y, seg AS a, region AS r FROM split WHERE split = 'train'),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM b),
j AS (SELECT y, a, r, count(*) AS c FROM b GROUP BY y, a, r),
py AS (SELECT y, count(*) AS c FROM b GROUP BY y),
pa AS (SELECT y, a, count(*) AS c FROM b GROUP BY y, a),
pr AS (SELECT y, r, count(*) AS c FROM b GROUP BY y, r)
SELECT round(sum(j.c / n * ln(CAST(j.c AS DOUBLE) * py.c / (CAST(pa.c AS DOUBLE) * pr.c))), 6) AS cmi
FROM j JOIN py USING (y) JOIN pa USING (y, a) JOIN pr USING (y, r), n""")
def q_bn_cmi(spark, sf):
    """M-05: conditional mutual information of segment and region."""
    m = recommender("BN", SPEC).fit(planted_split(spark, sf).where("split = 'train'"))
    i, j = SPEC.features.index("seg"), SPEC.features.index("region")
    return m.information.where((F.col("i") == i) & (F.col("j") == j)).select(r6(F.col("cmi")).alias("cmi"))


@query("model_roundtrip", with_sql(*_PSPLIT, O.zscore_sql("split", SPEC), O.nb_proba_sql("z", SPEC)) + """
SELECT row_id, cid AS class_id, round(p, 6) AS proba FROM nbp""")
def q_model_roundtrip(spark, sf):
    """S-08: a fitted model written, read back and scored."""
    import uuid
    from lacuna.models.registry import load_model, save_model
    from lacuna.session import shared_folder
    s = planted_split(spark, sf)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    save_model(recommender("NB", SPEC).fit(s.where("split = 'train'")), spark, path)
    p = load_model(spark, path).proba(s.where("split = 'test'"))
    return proba_long(p).select("row_id", "class_id", r6(F.col("proba")).alias("proba"))


@query("impute_mice_bayes")
def q_impute_mice(spark, sf):
    """I-01 + I-10: chained Bayesian-ridge posterior draws, 10 rounds, fitted
    on train, replayed on every split (rows-only check; the chain is tested
    against NumPy)."""
    return _imputed(spark, sf, "mice_bayes")


@query("impute_mice_forest")
def q_impute_forest(spark, sf):
    """I-02 + I-10: chained random forests."""
    return _imputed(spark, sf, "mice_forest")


@query("impute_mice_boosted")
def q_impute_boosted(spark, sf):
    """I-06 + I-10: chained boosted trees, 20 of depth 5 at rate 0.3."""
    return _imputed(spark, sf, "mice_xgb")


@query("impute_mice_lgbm")
def q_impute_lgbm(spark, sf):
    """I-07 + I-10: chained boosted trees, 20 of depth 5 at rate 0.1, leaves
    of 20 rows or more."""
    return _imputed(spark, sf, "mice_lgbm")


@query("impute_mice_svm")
def q_impute_svm(spark, sf):
    """I-04 + I-10: chained epsilon-insensitive linear regressions."""
    return _imputed(spark, sf, "mice_svm")


@query("impute_mice_gp")
def q_impute_gp(spark, sf):
    """I-03 + I-10: chained Gaussian processes with posterior draws."""
    return _imputed(spark, sf, "mice_gp")


@query("impute_views")
def q_impute_views(spark, sf):
    """I-11: M = 3 seeded completions of train over 10 rounds (view 0 also
    completes valid and test), long form with a view column."""
    from lacuna.operators.mice import completions
    s = planted_split(spark, sf, nulls=True)
    frames = {n: s.where(F.col("split") == n).select("row_id", *FEATS) for n in ("train", "valid", "test")}
    c = completions(frames["train"], frames, FEATS, m=3, seed=42, rounds=10, codes=tuple(SPEC.sparse))
    return _named(c, "row_id", "view", "split")


_STEP_SQL = with_sql(PLANTED_NULLS_SQL) + """
, o AS (SELECT CAST(price AS DOUBLE) AS x, CAST(premium AS DOUBLE) AS y FROM pnull WHERE price IS NOT NULL AND premium IS NOT NULL)
SELECT count(*) AS n, round(regr_slope(y, x), 4) AS slope FROM o"""


@query("ridge_step", _STEP_SQL)
def q_ridge_step(spark, sf):
    """I-01: one Bayesian-ridge conditional (premium from price) by
    sufficient statistics; with one strong predictor the evidence leaves the
    least-squares slope."""
    from lacuna.operators.mice import bayesian_ridge
    from lacuna.operators.stats import gram
    d = policy_nulls(spark, sf, planted=True)
    st = gram(d, ["price"], "premium")
    return d.where("price IS NOT NULL AND premium IS NOT NULL").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "slope", F.round(F.lit(float(bayesian_ridge(st)[0][0])), 4))


# ---- X-01, X-02, X-04: runs over the planted table

def _run_sql(ratio: float, seed: int, name: str, only_train: bool) -> tuple[list, str]:
    """CTEs and metric rows of one NB run with the mean imputer."""
    parts, ctes = [], []
    for part in ("train", "valid", "test"):
        src = f"{name}_{part}0"
        ctes.append(f"{src} AS (SELECT * FROM split WHERE split = '{part}')")
        if only_train and part != "train":
            parts.append(f"SELECT row_id, split, product_item, {', '.join(FEATS)} FROM {src}")
            continue
        masked = sql_mask_random(src, SPEC, ratio, seed, f"{name}_{part}")
        ctes.append(masked)
        parts.append(f"SELECT row_id, '{part}' AS split, product_item, {', '.join(FEATS)} FROM {name}_{part}")
    ctes.append(f"{name}_all AS ({' UNION ALL '.join(parts)})")
    ctes.append(f"{name}_m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in FEATS)} FROM {name}_all WHERE split = 'train')")
    fill = ", ".join((f"round_even(coalesce(CAST({c} AS DOUBLE), m_{c}), 0)" if c in SPEC.sparse
                      else f"coalesce(CAST({c} AS DOUBLE), m_{c})") + f" AS {c}" for c in FEATS)
    ctes.append(f"{name}_f AS (SELECT row_id, split, product_item, {fill} FROM {name}_all, {name}_m)")
    ctes += [O.zscore_sql(f"{name}_f", SPEC, name=f"{name}_z"), O.nb_proba_sql(f"{name}_z", SPEC, name=f"{name}_p"),
             O.topk_sql(f"{name}_p", name=f"{name}_k"), O.auc_sql(f"{name}_p", name=f"{name}_a")]
    eps = f"CAST({M.EPS!r} AS DOUBLE)"
    ctes.append(f"{name}_h AS (SELECT row_id, min(CASE WHEN cid = y AND rnk <= 3 THEN rnk END) AS r FROM {name}_k GROUP BY row_id)")
    values = [("auc", f"SELECT avg(auc) FROM {name}_a"),
              ("logloss", f"SELECT -avg(ln(greatest(least(p, 1.0 - {eps}), {eps}))) FROM {name}_p WHERE cid = y"),
              ("hr_k", f"SELECT avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM {name}_h"),
              ("ndcg_k", f"SELECT avg(coalesce(1.0 / log2(r + 1), 0.0)) FROM {name}_h")]
    rows = " UNION ALL ".join(
        f"SELECT 'NB' AS model, 'mean' AS imputer, CAST({ratio!r} AS DOUBLE) AS ratio, CAST({seed} AS BIGINT) AS seed, "
        f"{i} AS ord, '{m}' AS metric, round(({q}), 6) AS score" for i, (m, q) in enumerate(values))
    return ctes, rows


def _rounded_scores(df):
    return df.withColumn("score", r6(F.col("score")))


_RUN = _run_sql(0.2, 0, "r0", False)


@query("pipeline_run", with_sql(*_PSPLIT, *_RUN[0]) + "\n" + _RUN[1])
def q_pipeline_run(spark, sf):
    """X-04: split, inject 20 % missing cells in every split, mean-impute,
    fit NB, score."""
    from lacuna.experiment import run
    return _rounded_scores(run(policy_planted(spark, sf), SPEC, model="NB", fill="mean", ratio=0.2, seed=0))


_GRID = [_run_sql(r, s, f"g{i}{j}", True) for i, r in enumerate((0.1, 0.3)) for j, s in enumerate((1, 2))]


@query("sweep_missing", with_sql(*_PSPLIT, *[c for g in _GRID for c in g[0]]) + "\n" + " UNION ALL ".join(g[1] for g in _GRID))
def q_sweep(spark, sf):
    """X-01: missing ratio x imputer x seed, train rows masked."""
    from lacuna.experiment import sweep
    return _rounded_scores(sweep(policy_planted(spark, sf), SPEC, fills=("mean",), ratios=(0.1, 0.3), seeds=(1, 2)))


@query("fit_timing")
def q_fit_timing(spark, sf):
    """X-02: seconds of the fit beside the scores of a run (rows-only)."""
    from lacuna.experiment import run
    return run(policy_planted(spark, sf), SPEC, model="NB", fill="mean", ratio=0.2, seed=0, timed=True)


@query("parameter_search", None)
def q_search(spark, sf):
    """X-03: the spaces of LR, KNN and the random forest by successive halving
    on valid log-loss (rows-only; the halving is tested on its own)."""
    from lacuna.search import search
    s = planted_split(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [search(s, SPEC, name) for name in ("LR", "KNN", "RF")])
