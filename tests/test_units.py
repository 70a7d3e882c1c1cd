"""N-checks: operators against small plain-NumPy / pandas calculations and
properties from SURVEY §5."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from main_data import SF_MID, SF_SMALL


def test_betainc_t_tail():
    from lacuna.operators.analytics import t_two_sided_p
    # tabulated two-sided Student t tails
    assert abs(t_two_sided_p(2.228, 10) - 0.05) < 1e-3
    assert abs(t_two_sided_p(3.169, 10) - 0.01) < 1e-3
    assert abs(t_two_sided_p(1.96, 1e6) - 0.05) < 1e-3
    assert abs(t_two_sided_p(0.0, 5) - 1.0) < 1e-12


def test_split_properties(spark):
    from lacuna.plans.catalog import policy_split
    s = policy_split(spark, SF_SMALL).toPandas()
    n = len(s)
    k = s.product_item.nunique()
    per = s.groupby(["split"]).product_item.nunique()
    assert all(per[x] == k for x in ("train", "valid", "test"))      # every class in every split
    assert s.row_id.is_unique and n == 1500                           # a partition of the rows
    assert (s.split == "train").sum() == max(int(n * 0.7), k)


def test_split_independent_of_partitioning(spark):
    from lacuna.operators.sample import split_guaranteed
    from lacuna.sources.fixtures import POLICY_SPEC, policy
    p = policy(spark, SF_SMALL)
    a = split_guaranteed(p.repartition(1), POLICY_SPEC).select("row_id", "split").toPandas()
    b = split_guaranteed(p.repartition(7), POLICY_SPEC).select("row_id", "split").toPandas()
    m = a.merge(b, on="row_id")
    assert (m.split_x == m.split_y).all()


def test_mask_exact_counts(spark):
    from lacuna.operators.missing import inject_missing
    from lacuna.sources.fixtures import POLICY_SPEC, policy
    p = policy(spark, SF_SMALL)
    m = inject_missing(p, POLICY_SPEC, 0.25, 3, "random").toPandas()
    for c in POLICY_SPEC.features:
        assert m[c].isna().sum() == int(1500 * 0.25)
    assert m.product_item.notna().all()                                # target never masked
    r = inject_missing(p, POLICY_SPEC, 0.1, 3, "row").toPandas()
    assert r[POLICY_SPEC.features].isna().all(axis=1).sum() == 150


def test_nb_matches_numpy(spark):
    from lacuna.models.nb import GaussianNB
    from lacuna.sources.fixtures import PLANTED_SPEC, policy_planted
    d = policy_planted(spark, SF_SMALL)
    m = GaussianNB(PLANTED_SPEC, standardize=False).fit(d)
    got = np.array([r.proba for r in m.proba(d).orderBy("row_id").collect()])
    pdf = d.orderBy("row_id").toPandas()
    X = pdf[PLANTED_SPEC.features].to_numpy(float)
    y = pdf.product_item.to_numpy()
    cls = np.unique(y)
    eps = 1e-9 * X.var(axis=0).max()
    jll = []
    for c in cls:
        xc = X[y == c]
        mu, var = xc.mean(0), xc.var(0) + eps
        jll.append(np.log(len(xc) / len(X)) - 0.5 * np.log(2 * np.pi * var).sum()
                   - 0.5 * ((X - mu) ** 2 / var).sum(1))
    jll = np.array(jll).T
    ref = np.exp(jll - jll.max(1, keepdims=True))
    ref /= ref.sum(1, keepdims=True)
    assert np.allclose(got, ref, atol=1e-9)


def test_nb_beats_prior_on_planted(spark):
    from lacuna.models.nb import GaussianNB
    from lacuna.operators.metrics import logloss_expr
    from lacuna.sources.fixtures import PLANTED_SPEC, policy_planted
    d = policy_planted(spark, SF_MID)
    m = GaussianNB(PLANTED_SPEC).fit(d)
    ll = m.proba(d).agg(logloss_expr().alias("l")).first()["l"]
    prior = d.groupBy("product_item").count().toPandas()
    q = prior["count"] / prior["count"].sum()
    assert ll < -(q * np.log(q)).sum()


def test_auc_matches_bruteforce(spark):
    from lacuna.operators.metrics import auc_per_class
    rng = np.random.default_rng(0)
    n, k = 300, 4
    P = rng.dirichlet(np.ones(k), n).round(2)
    y = rng.integers(0, k, n)
    df = spark.createDataFrame([(int(a), [float(v) for v in p]) for a, p in zip(y, P)], "product_item long, proba array<double>")
    got = {r.class_id: r.auc for r in auc_per_class(df).collect()}
    for c in range(k):
        s = P[:, c]
        pos, neg = s[y == c], s[y != c]
        ref = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
        assert abs(got[c] - ref) < 1e-12


def test_kth_keys_exact(spark):
    from lacuna.functions.draws import uniform
    from lacuna.operators.rank import first_k_flag, kth_keys
    o = spark.read.parquet(f"{SF_MID}/orders.parquet").select("o_orderkey")
    d = o.select(F.lit("g").alias("g"), uniform(5, "t", "o_orderkey").alias("u"), "o_orderkey")
    for k in (1, 777, 15000, 20000):
        thr = kth_keys(d, {"g": k}, "g", "u", "o_orderkey", max_exact=50)
        n = d.where(first_k_flag(F.col("u"), F.col("o_orderkey"), thr["g"])).count()
        assert n == min(k, 15000)


@pytest.mark.parametrize("query,rounds,depth", [("q_rec_gbt", 100, 6), ("q_rec_lgbm", 100, 5), ("q_rec_catb", 200, 6)])
def test_boosted_queries_run_the_presets(monkeypatch, query, rounds, depth):
    from lacuna.plans import q_models
    monkeypatch.setattr(q_models, "_fit_score", lambda spark, sf, model: model)
    model = getattr(q_models, query)(None, None)
    assert model.params == {} and (model._param("n_estimators"), model._param("max_depth")) == (rounds, depth)
