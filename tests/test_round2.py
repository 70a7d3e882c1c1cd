"""Ranks by value, plans, chained imputation, models on disk, runs."""

import math
import os
import subprocess
import sys
import textwrap
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from main_data import SF_SMALL

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_positions_spread_values_with_a_long_common_prefix(spark):
    from lacuna.operators.rank import _ranged, ordered_positions
    df = spark.range(4000).select(F.format_string("Customer#%09d", (F.col("id") * 7919) % 4000).alias("s"))
    buckets = _ranged(df, ["s"]).groupBy("_rb").count().collect()
    assert len(buckets) >= 6 and max(r["count"] for r in buckets) < 4000 / 4
    got = {r.s: r.pos for r in ordered_positions(df, ["s"], "pos").collect()}
    assert got == {s: i + 1 for i, s in enumerate(sorted(got))}


def test_dictionary_is_one_plan_and_sorted(spark):
    from lacuna.operators.dictionary import factorize
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", None, "c", "a"])], "i long, v string")
    assert {r.i: r.code for r in factorize(df, "v", "code").collect()} == {0: 1, 1: 0, 2: -1, 3: 2, 4: 0}


def test_nearest_value_with_a_heavy_value(spark):
    from lacuna.operators.rank import nearest_value
    rng = np.random.default_rng(1)
    ref = sorted(set(rng.integers(0, 1000, 60).tolist()))
    ask = rng.integers(-50, 1100, 300).tolist() + [500] * 400
    q = spark.createDataFrame([(i, float(v)) for i, v in enumerate(ask)], "i long, v double")
    r = spark.createDataFrame([(float(v),) for v in ref], "v double")
    for x in nearest_value(q, r, "v").collect():
        best = min(abs(x.v - y) for y in ref)
        assert x.snapped == max(y for y in ref if abs(x.v - y) == best)


def test_split_has_no_sort_aggregate_and_profile_no_expand(spark):
    from lacuna.operators import sample, stats
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 5).alias("product_item"), F.col("id").alias("x"))
    key = F.lit(1).cast("decimal(17,0)") * F.expr("CAST('18446744073709551616' AS DECIMAL(20,0))")
    minima = df.withColumn("_s", key.cast("decimal(38,0)")).groupBy("product_item").agg(F.min("_s"))
    assert "SortAggregate" not in plan(minima) and "HashAggregate" in plan(minima)
    p = stats.column_profile(df, ["product_item", "x"])
    assert "Expand" not in plan(p)
    assert {(r.col, r.nunique) for r in p.collect()} == {("product_item", 5), ("x", 100)}
    assert sample.split_guaranteed(df, SimpleNamespace(item="product_item", row_id="row_id"), 0.7, 0.1).groupBy(
        "split").count().count() == 3


def test_products_of_large_codes_do_not_overflow(spark):
    from lacuna.operators.stats import suff_stats
    df = spark.createDataFrame([(4_000_000_000, 5_000_000_000)] * 3, "a long, b long")
    got = {r.name: r.value for r in suff_stats(df, ["a", "b"]).collect()}
    assert got["xx_a_b"] == pytest.approx(6e19)


def test_numerals_and_white_space(spark):
    from lacuna.functions import clean as C
    df = spark.createDataFrame([(v,) for v in ["nan", "10d", " 1e2 ", "-3.5", ".5", "inf", "", None, "　7　", "0x10"]], "v string")
    assert [r.n for r in df.select(C.to_number("v").alias("n")).collect()] == [None, None, 100.0, -3.5, 0.5, None, None, None, 7.0, None]
    text = spark.createDataFrame([("　\x85文員 \x1f",)], "v string").select(C.trim_ws("v").alias("t")).first().t
    assert text == "　\x85文員 \x1f".strip()


def test_mean_fill_scale_is_that_of_the_filled_column(spark):
    from lacuna.functions.scale import MeanFillScale
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (8.0,)], "x double")
    filled = np.array([1.0, 3.0, 4.0, 8.0])
    z = [r.z for r in df.select(MeanFillScale.fit(df, ["x"]).expr("x").alias("z")).collect()]
    assert z == pytest.approx(((filled - filled.mean()) / filled.std()).tolist())


@pytest.mark.parametrize("t,df,p", [(2.0, 1e12, 0.0455002639), (12.7062047, 1, 0.05), (2.2281389, 10, 0.05), (3.1692727, 10, 0.01),
                                    (1.9799304, 120, 0.05), (0.0, 3, 1.0), (100.0, 1e4, 0.0), (63.656741, 1, 0.01)])
def test_t_tail(t, df, p):
    from lacuna.operators.analytics import t_two_sided_p
    assert t_two_sided_p(t, df) == pytest.approx(p, abs=1e-7)
    assert t_two_sided_p(-t, df) == t_two_sided_p(t, df)


def test_t_tail_is_continuous_at_the_normal_limit():
    from lacuna.operators.analytics import t_two_sided_p
    assert t_two_sided_p(2.0, 0.999e7) == pytest.approx(math.erfc(2.0 / math.sqrt(2)), abs=1e-7)


def planted(n=400, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(10, 3, n)
    b = 2 * a + rng.normal(0, 0.3, n)
    c = np.clip(np.round(a / 4), 0, 6)
    x = np.column_stack([c, a, b])
    miss = rng.random(x.shape) < 0.2
    return x, miss


def frame(spark, x, miss):
    rows = [(i, *[None if m else float(v) for v, m in zip(r, k)]) for i, (r, k) in enumerate(zip(x, miss))]
    return spark.createDataFrame(rows, "row_id long, c double, a double, b double")


def filled(imp, df, n):
    out = imp.transform(df).orderBy("row_id").select("c", "a", "b").collect()
    assert len(out) == n
    return np.array(out, float)


def test_chain_without_draws_matches_numpy(spark):
    from lacuna.operators.mice import MiceImputer, bayesian_ridge
    x, miss = planted()
    df = frame(spark, x, miss)
    got = filled(MiceImputer(["c", "a", "b"], rounds=3, sample_posterior=False).fit(df), df, len(x))
    seen = np.where(miss, np.nan, x)
    mean, lo, hi = np.nanmean(seen, axis=0), np.nanmin(seen, axis=0), np.nanmax(seen, axis=0)
    cur = np.where(miss, mean, x)
    order = sorted(range(3), key=lambda j: (miss[:, j].sum(), j))
    for _ in range(3):
        for j in order:
            o, ok = np.delete(cur, j, axis=1) - np.delete(mean, j), ~miss[:, j]
            y = cur[:, j] - mean[j]
            st = {"n": ok.sum(), "sx": o[ok].sum(0), "sy": y[ok].sum(), "yy": y[ok] @ y[ok], "xy": o[ok].T @ y[ok], "xx": o[ok].T @ o[ok]}
            coef, b, *_ = bayesian_ridge(st)
            cur[miss[:, j], j] = np.clip(o[miss[:, j]] @ coef + b + mean[j], lo[j], hi[j])
    assert np.allclose(got, cur, atol=1e-6)


@pytest.mark.parametrize("name,rounds", [("mice_bayes", 5), ("mice_forest", 1), ("mice_xgb", 1), ("mice_gp", 1), ("knn", 1)])
def test_imputers_beat_the_mean(spark, name, rounds):
    from lacuna.operators.mice import imputer
    x, miss = planted(300)
    df = frame(spark, x, miss)
    err = lambda m: float(np.sqrt(((filled(m.fit(df), df, len(x)) - x)[miss[:, 2], 2] ** 2).mean()))
    got = filled(imputer(name, ["c", "a", "b"], codes=("c",), rounds=rounds).fit(df), df, len(x))
    assert np.allclose(got[~miss], x[~miss]) and np.isfinite(got).all()
    assert (got[:, 0] == np.round(got[:, 0])).all()
    assert err(imputer(name, ["c", "a", "b"], rounds=rounds)) < 0.8 * err(imputer("mean", ["c", "a", "b"]))


def test_completions_differ_by_seed_only_where_missing(spark):
    from lacuna.operators.mice import completions
    x, miss = planted(120)
    df = frame(spark, x, miss)
    out = completions(df, {"train": df, "test": df}, ["c", "a", "b"], m=2, rounds=2)
    rows = {}
    for r in out.where("split = 'train'").collect():
        rows.setdefault(r.view, {})[r.row_id] = (r.c, r.a, r.b)
    one, two = (np.array([rows[v][i] for i in range(len(x))]) for v in (0, 1))
    assert np.allclose(one[~miss], two[~miss]) and not np.allclose(one[miss], two[miss])
    assert out.where("split = 'test'").select("view").distinct().count() == 1


def test_names_are_checked():
    from lacuna.models.registry import recommender
    from lacuna.operators.mice import imputer
    from lacuna.spec import FeatureSpec
    with pytest.raises(ValueError):
        imputer("no such", [])
    with pytest.raises(ValueError):
        recommender("no such", FeatureSpec())


@pytest.fixture(scope="module")
def split(spark):
    from lacuna.plans.q_models import planted_split
    return planted_split(spark, SF_SMALL)


@pytest.mark.parametrize("name,params", [("NB", {}), ("LR", {}), ("RF", {"n_estimators": 10, "max_depth": 6}),
                                         ("XGB", {"n_estimators": 3, "max_depth": 3}), ("LGBM", {"n_estimators": 3}),
                                         ("CatB", {"n_estimators": 3, "max_depth": 3}), ("BN", {}), ("KNN", {})])
def test_models_beat_the_prior_and_survive_disk(spark, split, tmp_path, name, params):
    from lacuna.models.registry import load_model, recommender, save_model
    from lacuna.plans.q_models import SPEC
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    counts = {r[0]: r[1] for r in train.groupBy("product_item").count().collect()}
    top = max(counts, key=counts.get)
    prior = test.where(F.col("product_item") == top).count() / test.count()
    model = recommender(name, SPEC, **params).fit(train)
    save_model(model, spark, str(tmp_path / name))
    best = lambda m: {r.row_id: (int(np.argmax(r.proba)), r.product_item) for r in m.proba(test).collect()}
    got = best(model)
    assert np.mean([p == y for p, y in got.values()]) > prior + 0.1
    assert best(load_model(spark, str(tmp_path / name))) == got


def test_naive_bayes_blocks_are_equal(spark, split, monkeypatch):
    from lacuna.models import nb
    from lacuna.models.registry import recommender
    from lacuna.plans.q_models import SPEC
    model = recommender("NB", SPEC).fit(split.where("split = 'train'"))
    rows = lambda: {r.row_id: r.proba for r in model.proba(split.where("split = 'test'")).collect()}
    one = rows()
    monkeypatch.setattr(nb, "CELLS", 7)
    assert rows() == one


def test_contrastive_loss_by_definition():
    from lacuna.operators.contrastive import supcon
    rng = np.random.default_rng(2)
    views, y = [rng.standard_normal((9, 4)) for _ in range(2)], np.array([0, 0, 1, 1, 1, 2, 2, 0, 3])
    f = np.vstack(views)
    f = f / np.linalg.norm(f, axis=1, keepdims=True)
    lab, total = np.concatenate([y, y]), 0.0
    for i in range(18):
        others = [a for a in range(18) if a != i]
        part = math.log(sum(math.exp(f[i] @ f[a] / 0.5) for a in others))
        pos = [a for a in others if lab[a] == lab[i]]
        total += part - np.mean([f[i] @ f[p] / 0.5 for p in pos])
    assert supcon(views, y, 0.5) == pytest.approx(total / 18, rel=1e-6)


def test_shared_folder_is_required_on_a_cluster():
    from lacuna.session import shared_folder
    conf = SimpleNamespace(get=lambda k, d=None: d)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_folder(fake)


def test_kernels_need_no_package_on_the_workers(tmp_path):
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from lacuna.session import get_session
        from lacuna.models.registry import recommender
        from lacuna.plans.q_models import SPEC
        from lacuna.sources.fixtures import policy_planted
        spark = get_session(master="local[2]", partitions=2)
        p = policy_planted(spark, {SF_SMALL!r})
        print(recommender("NB", SPEC).fit(p).proba(p).count())
        import lacuna
        from pyspark.sql import functions as F
        assert recommender("NB", SPEC).fit(p).proba(p).agg(F.sum(F.size("proba"))).first()[0] > 0
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
