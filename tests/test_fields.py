"""Field embeddings and bilinear pairs against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import interactions as I
from lacuna.operators.fields import field_embed, hot_codes


def plain_pairs(v, w):
    out = []
    for i, j in I.pair_fields(len(v)):
        out += list((np.asarray(v[i]) @ w[i if len(w) > 1 else 0]) * np.asarray(v[j]))
    return out


@pytest.mark.parametrize("kind", ["shared", "each"])
def test_bilinear_pairs(spark, kind):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(20, 3, 4)), rng.normal(size=(1 if kind == "shared" else 3, 4, 4))
    rows = [(k, v.ravel().tolist()) for k, v in enumerate(x)] + [(20, None), (21, [1.0]), (22, [None] * 12)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    table = spark.createDataFrame([(None if kind == "shared" else f, r, c, float(w[f, r, c])) for f in range(len(w))
                                   for r in range(4) for c in range(4)], "field int, row int, col int, weight double")
    got = {r.id: r.p for r in df.select("id", I.bilinear_pairs(F.col("v"), 3, 4, I.bilinear_weights(table, 3, 4)).alias("p")).collect()}
    assert got[20] is None and got[21] is None and got[22] is None
    for k, v in enumerate(x):
        assert np.allclose(got[k], plain_pairs(v, w))


def test_bilinear_weights_are_checked(spark):
    mixed = spark.createDataFrame([(None, 0, 0, 1.0), (1, 0, 0, 1.0)], "field int, row int, col int, weight double")
    with pytest.raises(ValueError):
        I.bilinear_weights(mixed, 2, 1)
    with pytest.raises(ValueError):
        I.bilinear_pairs(F.col("v"), 3, 1, np.ones((2, 1, 1)))


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_field_embed(spark, hot_rows):
    rows = [(k, 0 if k % 3 else k % 4, None if k == 5 else k % 2, None if k == 7 else float(k), "x") for k in range(90)]
    df = spark.createDataFrame(rows, "row_id long, a long, b long, z double, vector string")
    table = {("a", 0): [1.0, 2.0], ("a", 1): [3.0, 4.0], ("a", 3): [5.0, 6.0], ("b", 0): [7.0, 8.0], ("b", 1): [9.0, 10.0]}
    t = spark.createDataFrame([(f, c, v) for (f, c), v in table.items()], "field string, code long, vector array<double>")
    out = field_embed(df, t, ["a", "b"], ["z"], {"z": ([0.5, 2.0], [1.0, -1.0])}, 2, hot_rows=hot_rows)
    assert out.columns == df.columns + ["fields"]
    got = {r.row_id: r.fields for r in out.collect()}
    assert len(got) == 90
    for k, a, b, z, _ in rows:
        line = [0.5 * (z or 0.0) + 1.0, 2.0 * (z or 0.0) - 1.0]
        assert got[k] == table.get(("a", a), [0.0, 0.0]) + table.get(("b", b), [0.0, 0.0]) + line


def test_hot_codes_are_split(spark):
    e = spark.createDataFrame([("a", 1)] * 23 + [("a", 2)] * 3, "field string, code long")
    assert [tuple(r) for r in hot_codes(e, 10).collect()] == [("a", 1, 3)]


def test_field_embed_of_an_empty_table_and_without_sparse_columns(spark):
    df = spark.createDataFrame([], "row_id long, a long, z double")
    t = spark.createDataFrame([], "field string, code long, vector array<double>")
    assert field_embed(df, t, ["a"], ["z"], {"z": ([1.0], [0.0])}, 1).count() == 0
    one = spark.createDataFrame([(1, 2.0)], "row_id long, z double")
    assert field_embed(one, t, [], ["z"], {"z": ([1.0], [0.5])}, 1).first().fields == [2.5]
