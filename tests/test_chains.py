"""Conditionals of the chained imputers against NumPy."""

import numpy as np
import pytest

from lacuna.operators import chains as C


def table(n=600, seed=5):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 10, n).round(3), rng.uniform(0, 5, n).round(3)
    y = np.where(a > 3, 4 * b, -2 * b) + rng.normal(0, 0.3, n)
    return np.column_stack([y, a, b, rng.integers(0, 3, n)]).astype(float)


def frame(spark, x, miss=None):
    gone = np.zeros(x.shape, bool) if miss is None else miss
    return spark.createDataFrame([(i, *[None if m else float(v) for v, m in zip(r, k)]) for i, (r, k) in enumerate(zip(x, gone))],
                                 "row_id long, y double, a double, b double, c double").repartition(2)


COLS = ["y", "a", "b", "c"]


@pytest.fixture(params=["in one task", "over jobs"])
def way(request, monkeypatch):
    """The solver beside a single block, and its sums over Spark's blocks."""
    if request.param == "over jobs":
        monkeypatch.setattr(C, "TASK_ROWS", 0)
        monkeypatch.setattr(C, "PARTITION_ROWS", 200)


def one_step(chain, df):
    """The first round's conditional of the first column alone."""
    from lacuna.session import stage
    chain._start(df)
    return chain._conditional(stage(chain._opened(df)), [], 0, 0)


def plain_trees(codes, y, base, trees, depth, bins, rate, penalty, least):
    """Boosting level by level with one histogram a column."""
    total, out = np.full(len(y), base), []
    for _ in range(trees):
        r, node = y - total, np.zeros(len(y), int)
        f, c = np.zeros((1 << depth) - 1, int), np.zeros((1 << depth) - 1, int)
        for level in range(depth):
            for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                own = node == k
                hist = np.stack([np.column_stack([np.bincount(codes[j, own], minlength=bins), np.bincount(codes[j, own], r[own], minlength=bins)])
                                 for j in range(len(codes))])
                f[k], c[k] = C.best_split(hist, penalty, least)
            node = 2 * node + 1 + (codes[f[node], np.arange(len(y))] > c[node])
        at = node - ((1 << depth) - 1)
        rows, sums = np.bincount(at, minlength=1 << depth), np.bincount(at, r, minlength=1 << depth)
        leaf = np.where(rows > 0, rate * sums / np.maximum(rows + penalty, 1e-300), 0.0)
        total = total + leaf[at]
        out.append((f, c, leaf))
    return out


@pytest.mark.parametrize("preset,depth", [("xgb", 5), ("lgbm", 5), ("xgb", 4), ("xgb", 1)])
def test_leaves_equal_plain_boosting(spark, way, preset, depth):
    x = table()
    chain = C.BoostedChain(COLS, preset=preset, trees=4, depth=depth, rounds=1)
    step = one_step(chain, frame(spark, x))
    rate, penalty, least = C.PRESETS[preset]
    want = plain_trees(step.codes(np.delete(x, 0, axis=1)), x[:, 0], x[:, 0].mean(), 4, depth, chain.bins, rate, penalty, least)
    codes = step.codes(np.delete(x, 0, axis=1))
    for k, (f, c, leaf) in enumerate(want):
        assert np.allclose(step.leaf[k], leaf, atol=1e-9)
        assert (C.nodes_of(codes, step.feature[k], step.cut[k], depth) == C.nodes_of(codes, f, c, depth)).all()


def loss(w, b, x, y, cost, epsilon):
    r = np.abs(y - x @ w - b)
    return 0.5 * (w @ w + b * b) + cost * np.maximum(0, r - epsilon).sum()


@pytest.mark.parametrize("cost,epsilon", [(1.0, 0.0), (0.01, 0.0), (1.0, 0.5)])
def test_support_vector_step_is_the_minimum(spark, way, cost, epsilon):
    x = table(300)
    chain = C.SupportVectorChain(COLS, cost=cost, epsilon=epsilon, rounds=1)
    step = one_step(chain, frame(spark, x))
    others, y = np.delete(x, 0, axis=1), x[:, 0]
    # subgradient steps with falling length from the solution and from zero
    best = got = loss(step.coef, step.intercept, others, y, cost, epsilon)
    rng = np.random.default_rng(0)
    for size in np.geomspace(1, 1e-4, 400):
        d = rng.normal(0, size, (50, 4)) * np.maximum(np.abs(np.append(step.coef, step.intercept)), 0.1)
        best = min(best, min(loss(step.coef + v[:3], step.intercept + v[3], others, y, cost, epsilon) for v in d))
    assert got <= best * (1 + 1e-4)
    assert got < 0.9 * loss(np.zeros(3), 0.0, others, y, cost, epsilon)


def test_gaussian_process_is_near_the_exact_one(spark):
    rng = np.random.default_rng(8)
    n = 500
    x = np.column_stack([np.zeros(n), rng.normal(0, 2, n), rng.uniform(0, 3, n), rng.normal(0, 1, n)])
    x[:, 0] = np.sin(x[:, 1]) + 0.5 * x[:, 2] + rng.normal(0, 0.1, n)
    chain = C.GaussianProcessChain(COLS, features=512, rounds=1)
    step = one_step(chain, frame(spark, x))
    z = (x[:, 1:] - step.mean) / step.scale
    new = rng.normal(0, 0.7, (40, 3))
    kernel = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(-1))
    solve, across = C.inverse(kernel(z, z) + chain.noise * np.eye(n)), kernel(new, z)
    weight = (solve * ((x[:, 0] - step.centre) / step.unit)).sum(axis=1)
    mean = step.centre + step.unit * (across * weight).sum(axis=1)
    var = 1.0 - np.array([((solve * v).sum(axis=1) * v).sum() for v in across]) + chain.noise
    got, sd = (np.concatenate(v) for v in zip(*[step.predict(r[None] * step.scale + step.mean) for r in new]))
    # stated error with 512 features: 15 % of the column's deviation
    assert np.sqrt(np.mean((got - mean) ** 2)) < 0.15 * step.unit
    assert np.median(np.abs(sd / (step.unit * np.sqrt(var)) - 1)) < 0.25


def test_inverse():
    a = np.random.default_rng(1).normal(size=(30, 40))
    a = a @ a.T + np.eye(30)
    assert np.allclose(C.inverse(a) @ a, np.eye(30), atol=1e-8)


def test_sums_by_either_way_are_equal(spark, monkeypatch):
    x = table(200)
    fit = lambda: one_step(C.GaussianProcessChain(COLS, features=32, rounds=1), frame(spark, x)).weight
    one = fit()
    monkeypatch.setattr(C, "TASK_ROWS", 0)
    monkeypatch.setattr(C, "PARTITION_ROWS", 64)
    assert np.allclose(fit(), one)
    monkeypatch.setattr(C, "DIRECT_CELLS", 0)
    assert np.allclose(fit(), one)


def test_chain_without_known_or_missing_cells(spark):
    x = table(50)
    gone = np.zeros(x.shape, bool)
    gone[:, 1] = True
    for chain in (C.BoostedChain(COLS, rounds=2, trees=2), C.SupportVectorChain(COLS, rounds=2, passes=5), C.GaussianProcessChain(COLS, features=16, rounds=2)):
        out = chain.fit(frame(spark, x, gone)).transform(frame(spark, x, gone)).orderBy("row_id").collect()
        assert np.allclose([(r.y, r.b, r.c) for r in out], x[:, [0, 2, 3]]) and all(r.a == 0.0 for r in out)


def jobs_of(spark, run):
    """Spark jobs that ``run`` starts, and its result."""
    sc, group = spark.sparkContext, f"jobs-{np.random.default_rng().integers(1 << 40)}"
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group)), out


@pytest.mark.parametrize("chain", [C.BoostedChain(COLS, trees=3, rounds=2), C.BoostedChain(COLS, preset="lgbm", trees=3, rounds=2),
                                   C.SupportVectorChain(COLS, rounds=2)])
def test_round_of_a_small_chain_is_one_job(spark, monkeypatch, chain):
    from lacuna.session import stage
    x, miss = table(300), np.random.default_rng(2).random((300, 4)) < 0.2
    df = frame(spark, x, miss)
    chain._start(df)
    state = stage(chain._opened(df))
    n, (own, after) = jobs_of(spark, lambda: chain._round(state, 0))
    assert n <= 2 and len(own) == 4     # four before, one a column
    moved = chain.moved
    rows = lambda t: np.array(t.orderBy("row_id").select(*[f"_x{i}" for i in range(4)]).collect(), float)
    assert np.isclose(moved, np.abs(rows(after) - rows(state)).max())
    # over jobs: the same steps, and the same change without a join by row
    chain.last = {}
    monkeypatch.setattr(C, "TASK_ROWS", 0)
    monkeypatch.setattr(C, "PARTITION_ROWS", 100)
    again, after2 = chain._round(state, 0)
    assert np.allclose(rows(after), rows(after2), atol=1e-6) and chain.moved is None
    for tol in (0.99, 1.01):
        chain.tol = tol * moved / max(np.abs(chain.lo).max(), np.abs(chain.hi).max())
        assert chain._settled(state, again) == (tol > 1)


def test_process_is_fitted_over_tasks_and_replays_a_step_once(spark, monkeypatch):
    from lacuna.session import stage
    monkeypatch.setattr(C, "PASS_ROWS", 64)
    x, miss = table(300), np.random.default_rng(2).random((300, 4)) < 0.2
    df = frame(spark, x, miss)
    chain = C.GaussianProcessChain(COLS, features=16, rounds=1)
    chain._start(df)
    opened = chain._opened(df)
    assert opened.rdd.getNumPartitions() == min(5, chain.slots)     # one before
    state = stage(opened.select("*", *chain._round_draws(0)))
    own, after = chain._round(state, 0)
    rows = lambda t: np.array(t.orderBy("row_id").select(*[f"_x{i}" for i in range(4)]).collect(), float)
    assert len(own) == 4 and len(chain.kept) == 2 and np.allclose(rows(after), rows(chain._after(state, own)))
    chain._release()
    assert not chain.kept


@pytest.mark.parametrize("preset", ["xgb", "lgbm"])
def test_trees_beside_a_block_are_those_of_the_sums_bit_by_bit(preset):
    """Ties between columns are broken by the last bits of the sums."""
    rng = np.random.default_rng(6)
    rate, penalty, least = C.PRESETS[preset]
    parts = []
    for n in (700, 0, 900, 3):
        a = rng.integers(0, 20, n)
        codes = np.stack([a, a % 5, rng.integers(0, 5, n), rng.integers(0, 32, n), a // 3]).astype(np.uint8)
        parts.append((n, codes.tobytes(), (a * 1.7 + codes[2] * 0.3 + rng.normal(0, 9, n)).tobytes(), {}))
    solver = C.TreeSolver(5, 32, 12, 5, rate, penalty, least, 3.3)
    whole = [(n, x, y, {}) for n, x, y, _ in parts]
    want = solver.solve(lambda length, add: C.block_sums(whole, length, add))
    got = solver.beside(parts)
    assert all((a == b).all() for a, b in zip(want[:3], got[:3])) and want[3] == got[3]


def test_a_step_of_a_tree_goes_through_all_blocks_at_once(monkeypatch):
    """Many small blocks in one task cost no call of each step for each of them."""
    taken, plain = [], np.take
    monkeypatch.setattr(C.np, "take", lambda *a, **k: taken.append(1) or plain(*a, **k))
    rng = np.random.default_rng(1)
    for blocks in (1, 30):
        taken.clear()
        parts = [(40, rng.integers(0, 32, (3, 40)).astype(np.uint8).tobytes(), rng.normal(size=40).tobytes(), {}) for _ in range(blocks)]
        C.TreeSolver(3, 32, 2, 5, 0.3, 1.0, 1.0, 0.0).beside(parts)
        calls = len(taken)
        assert 0 < calls < 100
