"""One chain for M completions against a chain of each."""

import numpy as np

from lacuna.operators.mice import MiceImputer, ViewChain, completions

COLS = ["a", "b", "c"]


def frame(spark, n=300):
    rng = np.random.default_rng(4)
    a = rng.normal(size=n)
    x = np.column_stack([a, 2 * a + rng.normal(0, 0.1, n), rng.integers(0, 4, n)])
    gone = rng.random(x.shape) < 0.2
    return spark.createDataFrame([(i, *[None if g else float(v) for v, g in zip(r, k)]) for i, (r, k) in enumerate(zip(x, gone))],
                                 "row_id long, a double, b double, c double").repartition(3)


def test_each_view_equals_its_own_chain(spark):
    df = frame(spark)
    chain = ViewChain(COLS, m=3, seed=42, rounds=3).fit(df)
    for v, view in enumerate(chain.views):
        own = MiceImputer(COLS, rounds=3, seed=42 + v).fit(df)
        assert len(view.steps) == len(own.steps) == 9
        for s, t in zip(view.steps, own.steps):
            assert (s.column, s.rnd) == (t.column, t.rnd) and np.allclose(s.coef, t.coef, rtol=1e-8, atol=1e-10)


def test_passes_do_not_grow_with_the_views(spark, monkeypatch):
    df, calls = frame(spark), []
    plain = ViewChain._replayed
    monkeypatch.setattr(ViewChain, "_replayed", lambda self, *a: calls.append(1) or plain(self, *a))
    for m in (1, 3):
        calls.clear()
        ViewChain(COLS, m=m, rounds=2).fit(df)
        assert len(calls) == 2 * 3 + 1


def test_completions_are_complete(spark):
    df = frame(spark)
    out = completions(df, {"train": df, "test": df}, COLS, m=2, rounds=2, codes=("c",))
    assert out.where("a IS NULL OR b IS NULL OR c IS NULL").count() == 0
    assert sorted(tuple(r) for r in out.groupBy("view", "split").count().collect()) == [(0, "test", 300), (0, "train", 300), (1, "train", 300)]


def test_a_pass_of_a_chain_needs_no_shuffle_and_no_package(spark, monkeypatch):
    """Sums are added in the tasks, draws are staged once a round, kernels
    travel by value."""
    from functools import _lru_cache_wrapper

    from lacuna.operators import mice
    assert not isinstance(mice._normal_table, _lru_cache_wrapper)   # would be pickled by name
    plans, plain = [], mice._added

    def added(batches, length):
        plans.append(batches._jdf.queryExecution().executedPlan().toString())
        return plain(batches, length)
    monkeypatch.setattr(mice, "_added", added)
    MiceImputer(COLS, rounds=2).fit(frame(spark))
    assert len(plans) == 2 * 3 and not any("md5" in p or "Exchange" in p for p in plans)


def test_draws_in_a_task_are_those_of_the_jvm(spark):
    from pyspark.sql import functions as F

    from lacuna.functions.draws import key_bytes, uniform, uniforms
    rows = spark.createDataFrame([(7,), (-3,), (None,), (1 << 62,)], "row_id long").select(
        F.col("row_id").cast("string").cast("binary").alias("k"), uniform(42, "mice|3|a", "row_id").alias("u")).collect()
    assert uniforms(42, "mice|3|a", key_bytes([None if r.k is None else bytes(r.k) for r in rows])).tolist() == [r.u for r in rows]
    assert len(uniforms(1, "s", [])) == 0


def test_a_pass_moves_blocks_of_rows(spark, monkeypatch):
    """The state of all views is a few values for thousands of rows, not a
    column for each cell of a row."""
    from lacuna.operators import mice
    seen, plain = [], mice.ViewChain._replayed
    monkeypatch.setattr(mice.ViewChain, "_replayed", lambda self, state, *a: seen.append((len(state.columns), state.count())) or plain(self, state, *a))
    df = frame(spark)
    mice.ViewChain(COLS, m=3, rounds=2).fit(df)
    assert all(columns == 6 and rows <= 8 for columns, rows in seen)
    missing = np.random.default_rng(3).random((50, 3)) < 0.3
    for gone in (missing, np.zeros((50, 3), bool)):
        x = np.random.default_rng(1).normal(size=(50, 3))
        block = mice.StateBlock([b"|%d" % i if i else b"" for i in range(50)], gone, [x, np.where(gone, 1.0, x)], [])
        block.drawn(["s|a", "s|b", "s|c"], [42, 43])
        row = mice._state_row(block)
        back = mice.StateBlock.unpacked([c[0].as_buffer() for c in row.columns[1:]], 50, 3, 2)
        assert (back.missing == gone).all() and all((a == b).all() for a, b in zip(back.xs, block.xs))
        assert bytes(back.keys).split(b"\n") == block.keys and len(block.draws[0]) == gone.sum()
        assert not back.draws or all((a == b).all() for a, b in zip(back.draws, block.draws))


def test_a_forest_is_applied_once(spark, monkeypatch):
    """Each column is fitted on the kept state after the one before it, not on
    a chain of forests that every pass of the fit applies anew."""
    from pyspark.ml.regression import RandomForestRegressor

    from lacuna.operators import mice
    plans, plain = [], RandomForestRegressor.fit

    def fit(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(self, df)
    monkeypatch.setattr(RandomForestRegressor, "fit", fit)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    chain = mice.TreeChain(COLS, rounds=1, trees=2, depth=2).fit(frame(spark))
    assert len(plans) == len(chain.steps) == 3 and "InMemoryRelation" not in plans[0] and all("InMemoryRelation" in p for p in plans[1:])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    monkeypatch.setattr(mice, "TASK_ROWS", 100)
    monkeypatch.setattr(mice, "LEAST_ROWS", 100)
    assert chain._dealt(chain._opened(frame(spark)), 300).rdd.getNumPartitions() == 3
    out = chain.transform(frame(spark))
    assert out.count() == 300 and out.where("a IS NULL OR b IS NULL OR c IS NULL").count() == 0
