"""The dataset manifest against a plain Merkle tree, and its multiproofs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import DOCS, SF
from lacuna.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        cur = out[-1]
        out.append([digest(*cur[k:k + 2]) for k in range(0, len(cur), 2)])
    return out


def beside(levels, i):
    out = []
    for cur in levels[:-1]:
        j = i ^ 1
        out.append((cur[j] if j < len(cur) else "", i % 2))
        i //= 2
    return out


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) -> the operator's rows."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for i, text, lang, source, n in rows:
        more = n + 1 if None not in (n, i) and zlib.crc32(str(i).encode()) % 7 == 0 else n
        trees.setdefault(lang, []).append((i, *[digest(*map(told, (i, source, lang, k, text))) for k in (n, more)]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[name] = levels_of([r[1] for r in trees[name]])
    top = levels_of([built[name][-1][0] for name in names])
    for t, name in enumerate(names):
        for at, (i, leaf, claimed) in enumerate(trees[name]):
            path = beside(built[name], at) + beside(top, t)
            got = claimed
            for other, odd in path:
                got = digest(other, got) if odd else digest(got, other)
            yield i, leaf, built[name][-1][0], top[-1][0], digest(*[s for s, _ in path]), got, got == top[-1][0]


def run(docs):
    m = merkle.build(merkle.document_leaves(docs))
    rows = merkle.prove(m, m.rows).select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")
    return Counter(map(tuple, rows.collect()))


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_whole_table_equals_a_plain_tree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert run(docs) == Counter(brute(rows_of(docs)))


def test_odd_rows_and_clashing_columns(spark, odd, clashing):
    want = Counter(brute(rows_of(odd)))
    assert run(odd) == want and run(clashing.withColumns({"tree": F.lit(1), "pos": F.lit(2), "claimed": F.lit("x")})) == want


def test_empty_table(spark, empty):
    m = merkle.build(merkle.document_leaves(empty))
    assert m.root is None and merkle.prove(m, m.rows).count() == 0


def test_runs_of_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 2)
    rows = [(i * 3 - 50, f"text {i}", ["en", "de", None, "solo"][0 if i < 70 else i % 3] if i else "solo", "s", i) for i in range(150)]
    assert run(spark.createDataFrame(rows, DOCS)) == Counter(brute(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 21])
def test_multiproof_is_enough_and_minimal(n):
    leaves = [digest(str(i)) for i in range(n)]
    whole, rng = levels_of(leaves), random.Random(n)
    for _ in range(20):
        known = sorted(rng.sample(range(n), rng.randint(1, n)))
        need = merkle.missing(np.array(known), n)
        assert len(need) <= len(known) * merkle.height(n)
        fetched = {(lv, i): whole[lv][i] for lv, i in need}
        got = merkle.derive({i: leaves[i] for i in known}, fetched, n)
        assert got[-1][0] == whole[-1][0]
        for i in known:
            path = merkle.siblings(got, i)
            assert path == [s for s, _ in beside(whole, i)] and merkle.fold(leaves[i], i, path) == whole[-1][0]
        for gone in need:
            part = merkle.derive({i: leaves[i] for i in known}, {c: d for c, d in fetched.items() if c != gone}, n)
            assert not part[-1]


def test_part_of_the_rows_proved_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = merkle.build(merkle.document_leaves(docs))
    some = m.rows.where(F.col("doc_id") % 13 == 0)
    got = {r.doc_id: r for r in merkle.prove(m, some).collect()}
    want = {r[0]: r for r in brute(rows_of(docs)) if r[0] % 13 == 0}
    assert {i: (r.leaf, r.proof, r.folded_root) for i, r in got.items()} == {i: (r[1], r[4], r[5]) for i, r in want.items()}
