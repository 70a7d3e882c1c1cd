"""Decontamination against a window-by-window version."""

import hashlib
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from llm_data import DOCS
from lacuna.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(ascii_uppercase, ascii_lowercase)
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(text, items, window=10):
    w, spans, names = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(window, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == b[k:k + n]:
                    spans.add((i, i + n))
                    names.add("" if item is None else str(item))
    return len(w), sorted(spans), sorted(names)


BODY = " ".join(f"Wort{i}" for i in range(14))
TEST_ITEMS = [(1, BODY), (2, "one Two, three"), (3, ""), (4, None), (None, "ÉCOLE élan"), (5, "solo"), (6, BODY), (6, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11"),
              (7, "a b c d e f g h i")]


def cases():
    texts = [BODY, "pre " * 3 + BODY.lower() + " post", BODY[6:], " ".join(BODY.split()[:9]), "ONE two-three one two three", "école élan",
             "ÉCOLE élan!", "école ÉLAN", "Solo solo, SOLO", "", None, " \n\x00 ", "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x1 x2 x3 x4 x5 x6 x7 x8 x9 x10",
             "z a b c d e f g h i z", "word " * 5000 + BODY + " end" * 7, "clean text with nothing of it at all, really nothing to be found here",
             "İstanbul Kelvin K one two three"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, BODY, None, None, None), (None, "clean", None, None, None), (0, "another text of id 0", "en", "s", 1)]


def check(spark, docs, rows, items, **options):
    got = sorted((str(r.doc_id), r.digest, r.n_words, [tuple(s) for s in r.spans], list(r.items))
                 for r in decontaminate.contamination(docs, spark.createDataFrame(items, ITEMS), **options).collect())
    keyed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want = sorted((str(r[0]), keyed[r[1]], *brute(r[1], items)) for r in rows)
    assert got == want


def test_against_brute_force(spark):
    rows = cases()
    check(spark, spark.createDataFrame(rows, DOCS).repartition(3), rows, TEST_ITEMS)


def test_set_in_parts_gives_the_same(spark):
    rows = cases()
    check(spark, spark.createDataFrame(rows, DOCS), rows, TEST_ITEMS, set_rows=7)


def test_empty_tables_and_clashing_columns(spark, odd, empty, clashing):
    rows = [tuple(r) for r in odd.collect()]
    check(spark, odd, rows, [])
    check(spark, clashing.withColumns({"words": F.lit(1), "span": F.lit(2), "items": F.lit(3)}), rows, [(1, "no id here")])
    assert decontaminate.contamination(empty, spark.createDataFrame(TEST_ITEMS, ITEMS)).count() == 0


def test_removal_of_spans_and_documents(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"digest": F.lit(1), "hit_id": F.lit(2), "c0": F.lit(3)})
    items = spark.createDataFrame(TEST_ITEMS, ITEMS)
    clean = decontaminate.remove_documents(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r[:2]) for r in clean.collect()) == sorted(str(r[:2]) for r in rows if not brute(r[1], TEST_ITEMS)[1])
    cut = decontaminate.remove_spans(docs, items)
    assert cut.columns == docs.columns
    want = []
    for r in rows:
        _, spans, _ = brute(r[1], TEST_ITEMS)
        own = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")
        text = " ".join(w for i, w in enumerate(own) if not any(s <= i < e for s, e in spans)) if spans else r[1]
        want.append(str((r[0], text)))
    assert sorted(str((r.doc_id, r.text)) for r in cut.collect()) == sorted(want)


def test_main_path_is_native_and_reads_texts_once(spark):
    docs = spark.createDataFrame(cases(), DOCS)
    df = decontaminate.contamination(docs, spark.createDataFrame(TEST_ITEMS, ITEMS))
    plan = df._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "ArrowEval"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_query_digest_of_items(spark):
    rows = [(1, BODY, "en", "s", 1)]
    r = decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(TEST_ITEMS, ITEMS)).select(
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("h"), decontaminate.n_covered(F.col("spans")).alias("n")).first()
    assert r.h == hashlib.sha256(b"1,6").hexdigest() and r.n == 14
