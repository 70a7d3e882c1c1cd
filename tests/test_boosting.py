"""Boosted recommenders: all classes in one chain of passes, equal to Spark ML's one-vs-rest trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.models import boosting as B
from lacuna.models.registry import recommender
from lacuna.spec import FeatureSpec

SPEC = FeatureSpec(item="y", sparse=("s",), dense=("a", "b"), row_id="row_id")


def table(spark, classes: int, n: int = 500):
    rng = np.random.default_rng(5)
    s, a, b = rng.integers(0, 6, n), rng.normal(size=n), rng.normal(size=n)
    y = (np.floor(2 * np.abs(a)).astype(int) + (b > 0) + (s % 3)) % classes
    return spark.createDataFrame([(i, int(s[i]), float(a[i]), float(b[i]), int(y[i])) for i in range(n)],
                                 "row_id long, s long, a double, b double, y long").coalesce(1)


def by_row(df):
    return np.array([r.proba for r in df.orderBy("row_id").collect()])


def spark_ml(df, nominal: bool, rounds: int, depth: int, rate: float, bins: int):
    """The probabilities of Spark ML's trees."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    meta = {"ml_attr": {"type": "nominal", "name": "s", "vals": [str(v) for v in range(7)]}} if nominal else {}
    x = df.select("row_id", F.col("y").cast("double").alias("label"), F.col("s").cast("double").alias("f0", metadata=meta), "a", "b")
    x = VectorAssembler(inputCols=["f0", "a", "b"], outputCol="features").transform(x)
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=42, maxBins=bins)
    out = OneVsRest(classifier=gbt).fit(x).transform(x).orderBy("row_id")
    m = np.array(out.select(vector_to_array("rawPrediction")).toPandas().iloc[:, 0].tolist())
    p = 1 / (1 + np.exp(-2 * m))
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("name,nominal", [("XGB", False), ("CatB", True)])
def test_equal_to_spark_ml(spark, name, nominal):
    df = table(spark, 3)
    model = recommender(name, SPEC, standardize=False, n_estimators=4, max_depth=3, learning_rate=0.3, max_bins=64).fit(df)
    got, want = by_row(model.proba(df)), spark_ml(df, nominal, 4, 3, 0.3, 64)
    # two splits that part the rows alike are equal but for rounding
    assert (np.abs(got - want).max(axis=1) < 1e-9).mean() > 0.98


def jobs_of(spark, run):
    sc, group = spark.sparkContext, f"jobs-{np.random.default_rng().integers(1 << 40)}"
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_classes(spark):
    fit = lambda k, t: jobs_of(spark, lambda: recommender("LGBM", SPEC, n_estimators=t, max_depth=3).fit(table(spark, k)))
    few, many, longer = fit(2, 2), fit(5, 2), fit(5, 4)
    assert many <= few + 1              # each class had jobs of its own before
    assert longer - many <= 2 * 3 + 1   # a level of a round is one job


def test_partitions_checkpoints_and_sums_in_spark_change_nothing(spark, monkeypatch):
    df = table(spark, 4)
    fit = lambda: by_row(recommender("CatB", SPEC, n_estimators=5, max_depth=3).fit(df).proba(df))
    one = fit()
    for name, value in (("EVERY", 2), ("LEAST_ROWS", 100), ("BLOCK", 64), ("DIRECT_CELLS", 0)):
        monkeypatch.setattr(B, name, value)
    assert (np.abs(fit() - one).max(axis=1) < 1e-9).mean() > 0.98
