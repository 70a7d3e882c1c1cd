import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm_data import SF
from lacuna.llm import quality as Q
from lacuna.llm import toxicity as T

MID = "/root/testdata/sf0.01"


def fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_on_held_out_rows(spark):
    from lacuna.llm.queries import QUERIES
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, MID).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r.held_out == fold(i) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels.items() if i in got and fold(i)]
    assert np.mean([p == y for p, y in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_held_out_labels_are_never_read(spark):
    from pyspark.sql import functions as F
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, labels), Q.fit(docs, flipped)
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.threshold, b.threshold)


def test_statistics_do_not_depend_on_the_batch(odd):
    texts = [r.text or "" for r in odd.collect()]
    whole = Q.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(Q.statistics(pa.array([t])), whole[i:i + 1], atol=1e-12), i
    assert np.isfinite(whole).all()
    assert Q.statistics(pa.array([], pa.string())).shape == (0, len(Q.FEATURES))


def test_flat_trees_equal_a_walk_by_node():
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = Q.fit_trees(x, y, rounds=20)
    assert ((m.score(x) > 0.5) == y).mean() > 0.97
    for row, want in zip(x[:20], m.margin(x[:20])):
        total = m.prior
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert total == pytest.approx(want)


def test_quality_without_usable_labels(spark, odd, empty):
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    m = Q.fit(odd, none)
    assert {r.score for r in Q.score(odd, m).collect()} == {0.5}
    assert Q.score(empty, m).count() == 0 and Q.accepted(odd, m, 0.4).count() == odd.count()
    assert Q.accepted(odd, m, 0.6).columns == odd.columns


def test_toxicity_finds_labelled_documents(spark):
    from lacuna.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    hit = got[got.toxic == 1].predicted.mean()
    clean = 1 - got[got.toxic == 0].predicted.mean()
    assert hit > 0.85 and clean > 0.99
    assert got.severity.between(0, 3).all()


def test_ordinal_thresholds_are_ordered_and_monotone():
    rng = np.random.default_rng(5)
    grade = rng.integers(0, 4, 600)
    owner = np.repeat(np.arange(600), grade)
    m = T.fit_ordinal(owner, np.zeros(len(owner), np.int64), grade, 1)
    assert (np.diff(m.thresholds) > 0).all()
    p = m.beyond(np.array([0.0, m.weights[0], 2 * m.weights[0]]))
    assert (np.diff(p, axis=1) <= 0).all()
    assert (np.diff(p.sum(axis=1)) > 0).all()


def test_ordinal_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(6)
    grade = rng.integers(0, 4, 50)
    owner, feature = np.repeat(np.arange(50), 2), rng.integers(0, 5, 100)

    def loss(m):
        p = m.beyond(np.bincount(owner, m.weights[feature], 50))
        full = np.column_stack([np.ones(50), p, np.zeros(50)])
        return -np.log(full[np.arange(50), grade] - full[np.arange(50), grade + 1]).mean() + T.RIDGE / 2 * (m.weights ** 2).sum()

    best = T.fit_ordinal(owner, feature, grade, 5)
    for k in range(5):
        for d in (-0.05, 0.05):
            w = best.weights.copy()
            w[k] += d
            assert loss(T.Ordinal(w, best.thresholds)) > loss(best) - 1e-4
    for d in (-0.05, 0.05):
        assert loss(T.Ordinal(best.weights, best.thresholds + d)) > loss(best) - 1e-4


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (10, 1, None), (11, 0, 0)], "doc_id long, quality int, toxic int")
    m = T.fit(odd, labels)
    assert T.score(odd, m).count() == odd.count() and T.score(empty, m).count() == 0
    none = T.fit(odd, labels.where("toxic = 0"))
    assert {round(r.severity, 6) for r in T.score(odd, none).collect()} == {0.0}
