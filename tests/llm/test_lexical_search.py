"""Ranked search against scoring every document."""

import math
import re
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_data import DOCS
from lacuna.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(ascii_uppercase, ascii_lowercase)
ITEMS = "item_id long, text string"


def terms(text):
    return [t.translate(LOW) for t in TERM.findall(text or "")]


def brute(rows, items, k):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows if terms(r[1])]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k])]
    return out


def corpus(n=300, seed=5):
    rng = np.random.default_rng(seed)
    names = [f"t{i}" for i in range(60)] + ["Été", "été", "x9", "漢字"]
    p = 1 / np.arange(1, len(names) + 1)
    rows = [(int(i) * 7 % 1000, " ".join(rng.choice(names, rng.integers(0, 40), p=p / p.sum())), "en", "s", 1) for i in range(n)]
    copy = "t3 t3 t50, T12; x9"
    return rows + [(5000 + i, copy, "en", "s", 1) for i in range(60)] + [(None, copy, None, None, None), (None, None, None, None, None),
                                                                         (9000, "", "en", "s", 0), (9001, " -- ", "en", "s", 0), (5000, copy, "en", "s", 1)]


def asked():
    return [(1, "t3 t50 t50 x9"), (2, "T0 t1 t2 t3 t4"), (3, "nowhere"), (4, ""), (5, None), (6, "ÉTÉ été Été"), (None, "t59 漢字"), (7, "t3")]


def ranked(spark, docs, items, **options):
    rows = L.search(docs, spark.createDataFrame(items, ITEMS), **options).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=lambda r: (str(r[0]), r[1]))


@pytest.mark.parametrize("cells,k", [(1 << 20, 20), (200, 7)])
def test_against_brute_force(spark, cells, k):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = sorted(brute(rows, asked(), k), key=lambda r: (str(r[0]), r[1]))
    assert ranked(spark, docs, asked(), k=k, shard_postings=cells) == want


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rows = corpus(80)
    monkeypatch.setattr(L, "ITEM_BLOCK", 2)
    want = sorted(brute(rows, asked(), 5), key=lambda r: (str(r[0]), r[1]))
    assert ranked(spark, spark.createDataFrame(rows, DOCS), asked(), k=5) == want


def test_odd_rows_empty_tables_and_clashing_columns(spark, odd, empty, clashing):
    items = [(1, "alpha gamma token5 and7"), (2, "w60 changed w61")]
    want = sorted(brute([tuple(r) for r in odd.collect()], items, 20), key=lambda r: (str(r[0]), r[1]))
    assert ranked(spark, odd, items) == want
    assert ranked(spark, clashing.withColumns({"ids": F.lit(1), "terms": F.lit(2), "item": F.lit(3)}), items) == want
    assert ranked(spark, empty, items) == [] and ranked(spark, odd, []) == []


def test_treap_holds_every_cell_and_its_maxima():
    rng = np.random.default_rng(2)
    cells = np.unique(rng.integers(0, (700, 90), (2000, 2)), axis=0)
    row, column = cells.T
    value = rng.integers(1, 10**6, len(row))
    height, bits, less = L.treap(row, column, value)
    t = L.Treap(height, len(bits), np.packbits(bits), less)
    assert t.top[0] == value.max()
    node = np.zeros(len(row), np.int64)
    for level in range(height):
        shift = height - 1 - level
        nxt = t.child(4 * node + 2 * ((row >> shift) & 1) + ((column >> shift) & 1))
        assert (nxt >= 0).all() and (t.top[nxt] <= t.top[node]).all()
        node = nxt
    assert (t.top[node] == value).all() and len(set(node.tolist())) == len(row)


def test_terms_keep_other_letters():
    words, offs = L.terms_of(pa.array(["Aé-B_c9\x7fÖ", "", "x"]))
    assert words.to_pylist() == ["aé", "b", "c9", "Ö", "x"] and offs.tolist() == [0, 4, 4, 5]
