import numpy as np

from lacuna.llm import vector_search as V

VEC = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if q % 50 == 0:
            s = [(-float(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)), i) for i, y in rows if i != q]
            out[q] = [(i, -v) for v, i in sorted((round(a, 12), b) for a, b in s)[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VEC)


def is_query():
    from pyspark.sql import functions as F
    return F.col("id") % 50 == 0


def test_recall_against_brute_force(spark):
    from lacuna.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, have = brute(rows), got(QUERIES["op6_vector_search"](spark, sf))
    assert set(want) == set(have) and all(len(v) == 5 for v in have.values())
    hit = np.mean([len({i for i, _ in have[q]} & {i for i, _ in w}) / 5 for q, w in want.items()])
    assert hit >= 0.9
    x = {i: np.array(v, float) for i, v in rows}
    for q, found in have.items():
        for i, s in found:
            assert abs(s - x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])) < 1e-12


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 120)] + [(i, rng.standard_normal(3).tolist()) for i in range(120, 200)]
    bad = [(300, None), (350, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (450, [float("nan"), 1.0, 1.0]),
           (500, [float("inf"), 1.0, 1.0]), (550, [1.0, 2.0]), (600, [])]
    have = got(V.nearest(frame(spark, rows + bad), is_query()))
    assert set(have) == {0, 50, 100, 150}
    assert [i for i, _ in have[0]] == [1, 2, 3, 4, 5] and [i for i, _ in have[100]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in have[150]] == [i for i, _ in brute(rows)[150]]


def test_few_rows_and_empty_tables(spark):
    assert V.nearest(frame(spark, []), is_query()).count() == 0
    assert V.nearest(frame(spark, [(50, None)]), is_query()).count() == 0
    have = got(V.nearest(frame(spark, [(0, [1, 0]), (1, [0, 1]), (2, [1, 1])]), is_query()))
    assert [i for i, _ in have[0]] == [2, 1]
    assert V.nearest(frame(spark, [(0, [1, 0])]), is_query()).count() == 0


def test_pigeonhole_probing_retrieves_the_whole_radius():
    rng = np.random.default_rng(4)
    import pandas as pd
    x = rng.standard_normal((300, 8))
    code = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    code[:150] = code[0] ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64))
    q = pd.DataFrame({"id": [0], "code": code[:1].view(np.int64), "vec": [x[0].tobytes()]})
    found = set()
    for j in range(V.PARTS):
        index = pd.DataFrame({"ids": [[i] for i in range(300)], "code": code.view(np.int64), "vec": [r.tobytes() for r in x], "part": j})
        out = V._search(8, 6, 300)(index, q)["ids"].map(lambda a: a[0]).tolist()
        assert not found & set(out)
        found |= set(out)
    assert found == set(np.flatnonzero(np.bitwise_count(code ^ code[0]) <= 6).tolist())


def test_many_scaled_copies_keep_the_smallest_ids(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal(6).round(2)
    # 40 different vectors of one direction, in an order unlike that of their ids
    rows = [(i, (base * s).tolist()) for i, s in zip(range(40), rng.permutation(np.arange(1, 41)).astype(float))]
    rows += [(i, rng.standard_normal(6).tolist()) for i in range(40, 120)]
    have = got(V.nearest(frame(spark, rows), is_query()))
    assert [i for i, _ in have[0]] == [1, 2, 3, 4, 5]
    assert all(abs(s - 1.0) < 1e-6 for _, s in have[0])


def test_only_codes_within_the_radius_are_multiplied(monkeypatch):
    import pandas as pd
    rng = np.random.default_rng(6)
    x, code = rng.standard_normal((500, 8)), rng.integers(0, 1 << 63, 500).astype(np.uint64)
    code[:60] = code[0] ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64))
    scored, plain = [], np.einsum
    monkeypatch.setattr(V.np, "einsum", lambda how, a, b: scored.append(len(a)) or plain(how, a, b))
    q = pd.DataFrame({"id": [0], "code": code[:1].view(np.int64), "vec": [x[0].tobytes()]})
    for j in range(V.PARTS):
        index = pd.DataFrame({"ids": [[i] for i in range(500)], "code": code.view(np.int64), "vec": [r.tobytes() for r in x], "part": j})
        V._search(8, 4, 500)(index, q)
    assert sum(scored) == (np.bitwise_count(code ^ code[0]) <= 4).sum()
