"""The pruned neighbour search against comparing every pair."""

import numpy as np
import pytest

from lacuna.operators import neighbors as N

FEATS = ["a", "b", "c", "d"]


def planted(n, seed, missing):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1000, n).round(1)
    x = np.column_stack([a, a * 0.1 + rng.normal(0, 20, n).round(1), rng.integers(0, 4, n), rng.normal(0, 50, n).round()])
    x[rng.random(n) < 0.3] = x[0]     # a hot point
    x[rng.random(x.shape) < missing] = np.nan
    return x


def brute(x, qids, y, dids, k, nan_euclidean, columns):
    out = {}
    d2 = N.distances(x, y, nan_euclidean)
    for i, q in enumerate(qids):
        for c in columns:
            if c and not np.isnan(x[i, FEATS.index(c)]):
                continue
            able = [(d2[i, j], int(dids[j])) for j in range(len(y))
                    if d2[i, j] < np.inf and (not c or not np.isnan(y[j, FEATS.index(c)]))]
            for rank, (far, who) in enumerate(sorted(able)[:k]):
                out[int(q), c, rank + 1] = (who, far)
    return out


@pytest.mark.parametrize("missing,donor_rows", [(0.0, 10 ** 6), (0.0, 60), (0.25, 10 ** 6), (0.25, 60)])
def test_equals_all_pairs(spark, monkeypatch, missing, donor_rows):
    monkeypatch.setattr(N, "DONOR_ROWS", donor_rows)
    monkeypatch.setattr(N, "QUERY_ROWS", 40)
    monkeypatch.setattr(N, "CELL_ROWS", 8)
    monkeypatch.setattr(N, "SAMPLE_ROWS", 200)
    x, y = planted(250, 1, missing), planted(400, 2, missing)
    frame = lambda m, first: spark.createDataFrame(
        [(first + i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(m)], "id long, a double, b double, c double, d double")
    columns = FEATS if missing else [""]
    got = N.knn_candidates(frame(x, 0), frame(y, 5000), "id", "id", FEATS, 3, missing > 0, FEATS if missing else None).collect()
    want = brute(x, range(250), y, range(5000, 5400), 3, missing > 0, columns)
    assert {(r.id, r.col, r["rank"]): (r.donor, r.d2) for r in got} == want and len(got) == len(want)
    for r in got:
        if r.col:
            assert r.value == y[r.donor - 5000, FEATS.index(r.col)]


def test_no_queries_or_donors(spark):
    some = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0)], "id long, a double, b double, c double, d double")
    none = some.where("id < 0")
    assert N.knn_candidates(none, some, "id", "id", FEATS, 3).count() == 0
    assert N.knn_candidates(some, none, "id", "id", FEATS, 3).count() == 0


def test_few_pairs_are_compared():
    rng = np.random.default_rng(3)
    x, y = (np.column_stack([a, a * 0.1 + rng.normal(0, 5, n), rng.integers(0, 5, n)]) for n in (4000, 20000) for a in [rng.uniform(0, 1000, n)])
    _, pairs = N.nearest(x, np.full((len(x), 1), np.inf), y, np.arange(len(y)), 5, [-1], False)
    assert pairs < 0.1 * len(x) * len(y)


def test_box_distance_is_below_every_distance():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, y = rng.normal(0, 1e5, (6, 4)), rng.normal(0, 1e5, (7, 4))
        x[:, rng.random(4) < 0.3], y[:, rng.random(4) < 0.3] = np.nan, np.nan
        low = N.box_distance(x.min(0), x.max(0), y.min(0)[None], y.max(0)[None], True)[0]
        assert (N.distances(x, y, True) >= low).all()


def test_ties_do_not_grow_with_the_donors():
    """Donors that share only codes with a query are as far as many others: the
    cells leave out columns that the query lacks, equal points count k times."""
    def pairs(n):
        rng = np.random.default_rng(5)
        y = np.column_stack([rng.integers(0, 3, n), rng.integers(0, 4, n), rng.normal(0, 1000, n), rng.normal(0, 9, n)]).astype(float)
        x = np.column_stack([rng.integers(0, 3, 64), rng.integers(0, 4, 64), np.full(64, np.nan), np.full(64, np.nan)])
        ids = rng.permutation(n)
        got, compared = N.nearest(x, np.full((64, 2), np.inf), y, ids, 3, [2, 3], True)
        far = N.distances(x, y, True)
        for at, col, rank, who, d2, value in zip(*got):
            order = np.lexsort((ids, far[at]))
            assert ids[order[rank - 1]] == who and far[at][order[rank - 1]] == d2 and y[order[rank - 1], col] == value
        assert len(got[0]) == 64 * 2 * 3
        return compared
    assert pairs(20_000) < 1.2 * pairs(5_000)


def test_query_tiles_visit_a_donor_tile_together(spark, monkeypatch):
    """A donor tile is moved once for a pack of query tiles, not for each."""
    from lacuna.operators import neighbors as N
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(5) if (a + b) % 4], "a int, b int")
    packs = [tuple(r) for r in N._packs(pairs, 16, 1).collect()]
    assert sorted((a, b) for a, b, _ in packs) == sorted(tuple(r) for r in pairs.collect())
    size = {}
    for _, b, pack in packs:
        size[b, pack] = size.get((b, pack), 0) + 1
    assert max(size.values()) == 16 and len(size) == 2 * 5
    assert len({(b, pack) for _, b, pack in N._packs(pairs, 16, 100).select("a", "b", "pack").toLocalIterator()}) == 150
    # the neighbours do not depend on packs
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(900, 3)).round(2), rng.normal(size=(1500, 3)).round(2)
    frame = lambda v: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "row_id long, a double, b double, c double")
    monkeypatch.setattr(N, "QUERY_ROWS", 32)
    monkeypatch.setattr(N, "DONOR_ROWS", 256)
    plain, moved = N._packs, []
    monkeypatch.setattr(N, "_packs", lambda pairs, most, slots: moved.append((pairs.count(), most)) or plain(pairs, most, 1))
    got = sorted((r.row_id, r["rank"], r.donor) for r in N.knn_candidates(frame(x), frame(y), "row_id", "row_id", ["a", "b", "c"], 4).collect())
    d2 = ((x[:, None] - y[None]) ** 2).sum(-1)
    order = np.lexsort((np.broadcast_to(np.arange(len(y)), d2.shape), d2), axis=1)[:, :4]
    assert [g[:2] for g in got] == [(i, r) for i in range(900) for r in (1, 2, 3, 4)]
    assert np.allclose([d2[i, donor] for i, _, donor in got], np.take_along_axis(d2, order, axis=1).ravel())
    assert len(moved) == 2 and all(n > 16 == most for n, most in moved)
