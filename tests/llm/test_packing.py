import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm_data import SF, odd_rows
from lacuna.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, texts, tokenizer):
    """texts: list of texts of each id."""
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    cover, sequences = {}, {}
    for r in rows:
        cover.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        assert len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(cover) == set(want)
    for i, pieces in cover.items():
        if len(want[i]) == 1:
            ids = b"".join(x for _, x in sorted(pieces))
            assert np.frombuffer(ids, "<u4").tolist() == want[i][0]
        assert sum(len(x) for _, x in pieces) == 4 * sum(map(len, want[i]))
    total = padding = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096
        total += at
        padding += 4096 - at if at & (at - 1) else 0
    assert padding <= 0.01 * total


def test_small_table(spark, tables, tokenizer):
    from lacuna.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = K.pack(docs, PATH).collect()
    check(rows, [r[:2] for r in tables("documents")], tokenizer)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in QUERIES["op8_packing"](spark, SF).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(r.ids) for r in rows)


def test_odd_rows(odd, empty, clashing, tokenizer):
    check(K.pack(odd, PATH).collect(), [r[:2] for r in odd_rows()], tokenizer)
    assert K.pack(empty, PATH).count() == 0
    check(K.pack(clashing, PATH).collect(), [r[:2] for r in odd_rows()], tokenizer)


def test_steps_hold_equal_token_counts(spark):
    rows = K.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH).collect()
    size, tier = {}, {}
    for r in rows:
        size[r.step_id] = size.get(r.step_id, 0) + r.length
        tier.setdefault(r.step_id, set()).add(r.tier)
    assert max(size.values()) <= K.STEP_TOKENS and all(len(t) == 1 for t in tier.values())
    full = sum(n == K.STEP_TOKENS for n in size.values())
    assert full >= 1


def test_words_encode_as_the_whole_tokenizer_does(tokenizer):
    import random
    rng = random.Random(3)
    alphabet = list("abcSTrelmvd'''0123456789.,!#$ \n\té") + ["É", "ß", "İ", "ŉ", "ſ", "K", "²", "½", "ª", "º", "漢", "\U0001F600",
                "Σ", "σ́", "​", "　", "\x85", "\xa0", "\x1c", "'s", "'RE", "'ll", "<|endoftext|>", "The"]
    w = K.WordTokens(PATH)
    for _ in range(40):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(50)]
        ids, at = w.encode(pa.array(texts), 2)
        for t, s, e in zip(texts, at, at[1:]):
            assert ids[s:e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [2]


def test_long_pieces_left_over_do_not_open_short_windows(spark, tokenizer):
    texts = [(1, "a " * 2999), (2, "a " * 99)]
    assert [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts] == [3000, 100]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    check(K.pack(df, PATH).collect(), texts, tokenizer)


def test_windows_lay_every_id_once():
    import random
    rng = random.Random(5)
    for turn in range(300):
        tops = rng.choice([[4095], [4095, 300], [2600, 2100, 100], [512, 1024, 2048, 4095]])
        lengths = [rng.randint(1, rng.choice(tops)) for _ in range(rng.randint(1, 40))]
        pool, seen = K.Pool(K.TIERS), []
        for last in (False, True):
            if not last:
                for i, n in enumerate(lengths):
                    pool.add((i, 0, n))
            for size, pieces in K.windows(pool, last):
                assert sum(n for *_, n in pieces) == size <= K.TIERS[-1]
                seen += pieces
            assert sum(pool.held) == pool.tokens
        assert pool.tokens == 0
        for i, n in enumerate(lengths):
            at = 0
            for start, length in sorted(p[1:] for p in seen if p[0] == i):
                assert start == at
                at += length
            assert at == n


def test_words_are_cut_together(tokenizer):
    """Fresh words take one call of the pattern, with the ids of single words;
    a pattern that runs over the end of a word is used word by word."""
    import random
    rng = random.Random(4)
    texts = ["".join(rng.choice("aAbé'sS1290_-^$ ßÜñɏµ²ĀİΣ<|>x.ll文\x7f") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["<|endoftext|> a<|endoftext|>b", "'S 'LL can't", ""]
    together, calls = K.WordTokens(PATH), []
    cut = together.cut
    together.cut = lambda text: calls.append(text) or cut(text)
    pattern, specials = K.spec_of(PATH)
    over = K.WordTokens(PATH, (pattern + "\\n?", specials))
    assert over.cut is not None
    over.pattern = together.pattern
    each = K.WordTokens(PATH, ("(?=.)(?:" + pattern + ")", specials))
    assert each.cut is None
    for w in (together, over, each):
        ids, at = w.encode(pa.array(texts), 2)
        for t, s, e in zip(texts, at[:-1], at[1:]):
            assert ids[s:e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [2]
    assert len(calls) == 1
