import hashlib
import re

import numpy as np

from llm_data import odd_rows
from lacuna.llm import exact_dedup as X


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        d = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        groups.setdefault(d, []).append(i)
    out = []
    for d, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, d, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.id, bytes(r.digest).hex(), r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


def test_matches_brute_force_on_odd_rows(odd):
    assert got(X.dedup(odd)) == brute(odd_rows())


def test_any_history_gives_the_same_groups(spark, odd):
    from pyspark.sql import functions as F
    for cond in (F.lit(True), F.lit(False), F.col("id") > 2):
        assert got(X.dedup(odd, cond)) == brute(odd_rows())


def test_empty_table_and_clashing_columns(empty, clashing):
    assert X.dedup(empty).count() == 0
    assert X.kept_rows(empty).count() == 0
    kept = X.kept_rows(clashing)
    assert kept.columns == clashing.columns
    assert kept.where("doc_id = 2").count() == 0 and kept.where("doc_id = 1").count() == 1


def test_one_row_stays_of_each_group(spark):
    rows = [(None, "same"), (None, "same"), (None, "same "), (3, "a  b"), (3, "a b"), (4, "a b"), (5, "c"), (5, "c"), (5, "d")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, kept int")
    got = sorted((str(r.doc_id), " ".join(r.text.split())) for r in X.kept_rows(df).collect())
    assert got == [("3", "a b"), ("5", "c"), ("5", "d"), ("None", "same"), ("None", "same")]


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    sizes, bits = X.build_levels(matrix)
    slots = X.slots_of(matrix, sizes, bits)
    assert sorted(slots) == list(range(5000)) and int(bits.sum()) == 5000
    held = np.empty_like(matrix)
    held[slots] = matrix
    other = rng.integers(0, 256, (2000, 32), dtype=np.uint8)
    s = X.slots_of(other, sizes, bits)
    assert not (held[s[s >= 0]] == other[s >= 0]).all(axis=1).any()


def test_a_hot_group_is_spread_over_salts(spark):
    from pyspark.sql import functions as F
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text")
                                    .otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    r = X.dedup(docs)
    assert r.where("keep_id = 0").count() == 1000 and r.where("kept").count() == 2001
    assert r.where("keep_id = 0 and group_size != 1000").count() == 0
