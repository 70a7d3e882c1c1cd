"""Oracle SQL of the subpackage, the pipeline against a plain version, and
the guard around the subpackage."""

import math
import os
import subprocess
import sys
import textwrap
from collections import Counter

import pytest

from llm_data import SF, words

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def all_sql():
    from lacuna.llm.queries import SQL
    return sorted(SQL)


@pytest.mark.parametrize("name", all_sql())
def test_oracle(spark, name):
    import duckdb
    from lacuna.llm.queries import QUERIES, SQL
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = Counter(tuple(norm(r[cols.index(c)]) for c in df.columns) for r in res.fetchall())
    assert Counter(tuple(norm(v) for v in r) for r in df.collect()) == want


def test_every_operator_has_a_query():
    import __spark_entry__ as E
    names = set(E.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline_stages_against_plain_versions(spark, tables):
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer
    from lacuna.llm import secrets
    from test_exact_dedup import brute as exact
    from test_near_dedup import brute as near
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    frames, columns = [docs], docs.columns
    for _, apply in P.STAGES[:-1]:
        from lacuna.session import stage
        frames.append(stage(apply(spark, frames[-1], SF), "test"))
        assert frames[-1].columns == columns
    rows = [[tuple(r) for r in f.collect()] for f in frames]
    labels = {i: q for i, q, _ in tables("labels")}
    kept = {r[0] for r in rows[1]}
    known = [(r[0] in kept) == (labels[r[0]] == 1) for r in rows[0] if r[0] in labels]
    assert sum(known) >= 0.95 * len(known)
    assert {r[0] for r in rows[2]} == {i for i, *_, k in exact(rows[1]) if k}
    assert {r[0] for r in rows[3]} == {i for i, _, c in near(rows[2], 5) if i == c}
    plain = {r[0]: secrets.redacted(r[1] or "", secrets.spans_of(r[1] or "")) for r in rows[3]}
    assert {r[0]: r[1] for r in rows[4]} == plain
    assert all(r[4] == len(r[1]) for r in rows[4] if plain[r[0]] != dict((x[0], x[1]) for x in rows[3])[r[0]])
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter({r[0]: len(tok.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows[4]})
    got = Counter()
    for r in P.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_entry_works_without_the_subpackage(tmp_path):
    code = textwrap.dedent(f"""
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("lacuna.llm"):
                    raise ModuleNotFoundError(name)
        sys.meta_path.insert(0, Gone())
        sys.path.insert(0, {REPO!r})
        import __spark_entry__ as E
        names = set(E.queries())
        assert "pipeline" not in names and not any(n.startswith("op1_") for n in names) and len(names) > 50
        assert set(E.oracle_sql()) <= names
    """)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_nothing_else_imports_the_subpackage():
    for root, _, files in os.walk(os.path.join(REPO, "lacuna")):
        if os.path.basename(root) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(root, f)) as text:
                    assert "lacuna.llm" not in text.read(), f


def test_words_helper_matches_the_pattern(odd):
    import pyarrow as pa
    from lacuna.llm import arrays as A
    texts = [r.text or "" for r in odd.collect()]
    got, offs = A.words_of(*A.text_buffer(pa.array(texts)))
    assert [got[int(s):int(e)].to_pylist() if e > s else [] for s, e in zip(offs, offs[1:])] == [words(t) for t in texts]
