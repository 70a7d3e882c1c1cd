"""Ensembles and augmentation by name, against their members."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.models.registry import recommender
from lacuna.spec import FeatureSpec

SPEC = FeatureSpec("item", ("a",), ("x", "y"), "row_id")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    out = []
    for i in range(240):
        c = int(rng.integers(0, 3))
        row = [float(rng.integers(0, 3) + c), float(rng.normal(c, 1)), float(rng.normal(-c, 1))]
        out.append((i, c, *[None if rng.random() < 0.2 else v for v in row]))
    return spark.createDataFrame(out, "row_id long, item int, a double, x double, y double")


def by_row(df):
    return {r.row_id: np.array(r.proba) for r in df.collect()}


def test_ensemble_is_the_mean_of_its_members(rows):
    train, test = rows.where("row_id < 180"), rows.where("row_id >= 180")
    m = recommender("Ensemble", SPEC, views=("mice_bayes", "mice_bayes", "mean"), rounds=2).fit(train)
    got = by_row(m.proba(test))
    assert len(got) == 60 and all(abs(p.sum() - 1) < 1e-9 for p in got.values())
    each = [by_row(one.proba(m.filled(v, test))) for v, one in enumerate(m.members)]
    for r, p in got.items():
        assert np.allclose(p, np.mean([e[r] for e in each], axis=0), atol=1e-12)
    # the views are seeded apart
    assert any(not np.allclose(each[0][r], each[1][r]) for r in got)


def test_augment_fits_one_member_on_all_views(rows):
    train, test = rows.where("row_id < 180"), rows.where("row_id >= 180")
    m = recommender("Augmented", SPEC, views=("mice_bayes", "mean"), rounds=2).fit(train)
    stacked = m.filled(0, train).unionByName(m.filled(1, train))
    alone = recommender("NB", SPEC).fit(stacked)
    want = by_row(alone.proba(m.filled(0, test)))
    got = by_row(m.proba(test))
    assert got.keys() == want.keys() and all(np.allclose(got[r], want[r], atol=1e-9) for r in got)


def test_views_must_be_named(rows):
    with pytest.raises(ValueError):
        recommender("Ensemble", SPEC, views=())
    with pytest.raises(RuntimeError):
        recommender("Ensemble", SPEC).proba(rows)
