import hashlib

import numpy as np

from llm_data import SF, odd_rows, words
from lacuna.llm import substring_dedup as S


def brute(rows):
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 49):
            g = tuple(w[k:k + 50])
            least[g] = min(least.get(g, order(i)), order(i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if least[tuple(w[k:k + 50])] < order(i):
                gone[k:k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_small_table_matches_brute_force(spark, tables):
    assert got(S.substring_dedup(spark.read.parquet(f"{SF}/documents.parquet"))) == brute(tables("documents"))


def passages():
    rng = np.random.default_rng(3)
    shared = [f"s{i}" for i in range(70)]
    rows = []
    for i in range(40):
        own = [f"o{x}" for x in rng.integers(0, 10_000, 60)]
        cut = int(rng.integers(0, 20))
        rows.append((i, " ".join(own[:30] + shared[cut:] + own[30:])))
    rows.append((50, " ".join(["same"] * 400)))
    rows.append((51, " ".join(["same"] * 300 + shared)))
    return rows


def test_shared_passages_in_differing_texts(spark, monkeypatch):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.substring_dedup(df)) == brute(rows)
    for hot in (2, 0):      # the same by longer minimisers and by windows
        monkeypatch.setattr(S, "HOT", hot)
        assert got(S.substring_dedup(df)) == brute(rows)


def test_longer_minimisers_cover_a_super_kmer():
    h = np.random.default_rng(5).integers(0, 1 << 60, 300).astype(np.uint64)
    sums = S.Sums(h)
    cuts = list(S._recut(sums, 90, 64))
    assert [c[0] for c in cuts] == np.cumsum([0] + [c[1] for c in cuts[:-1]]).tolist() and sum(c[1] for c in cuts) == 64
    for skip, n, longer in cuts:
        for k in range(skip, skip + n):
            runs = sums.run(90 + k + np.arange(S.WINDOW - S.LONG_MER + 1), S.LONG_MER)
            assert runs.min().view(np.int64) == longer


def test_odd_rows(odd, empty, clashing):
    assert got(S.substring_dedup(odd)) == brute(odd_rows())
    assert S.substring_dedup(empty).count() == 0
    assert got(S.substring_dedup(clashing)) == brute(odd_rows())


def test_super_kmers_cover_every_window_once():
    h = np.random.default_rng(4).integers(0, 1 << 60, 700).astype(np.uint64)
    woffs = np.array([0, 30, 30, 400, 450, 700])
    text, start, windows, least, _ = S.super_kmers(h, woffs)
    seen = [(t, s + k) for t, s, n in zip(text, start, windows) for k in range(n)]
    assert sorted(seen) == [(t, k) for t, n in enumerate(np.diff(woffs)) for k in range(n - 49)]
    assert windows.max() <= S.LONGEST
