import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from llm_data import SF, odd_rows
from lacuna.llm import arrays as A
from lacuna.llm import byte_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return B.Ranks(PATH)


def test_random_texts(oracle, ranks):
    rng = random.Random(1)
    alphabet = list("abcdelrstvm'''  \n\t  .!?123éß漢字 　\U0001F600́ſ½\x1c\x85") + ["'s", "'re", "'ll", "'ve", " the", ". "]
    encoder, decoder = B.Encoder(ranks, B.class_table()), B.Decoder(ranks)
    for _ in range(30):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(200)]
        texts += ["a" * 700 + "'s" * 40, "ab" * 300, "", " ", "\n\n", "'", "'s", "'r", "'re", "x'", " 's", "!'s", "\n's's"]
        buf, offs = A.text_buffer(pa.array(texts))
        ids, at = encoder.encode(buf, offs)
        assert decoder.decode(ids)[0].tobytes() == buf.tobytes()
        for t, s, e in zip(texts, at, at[1:]):
            assert ids[s:e].tolist() == oracle.encode_ordinary(t), repr(t)


def test_composition_is_associative_and_scans_agree():
    rng = np.random.default_rng(2)
    f, g, h = rng.integers(0, 256, (3, 500))
    c = B.COMPOSE.astype(int)
    assert (c[c[f * 256 + g] * 256 + h] == c[f * 256 + c[g * 256 + h]]).all()
    functions = rng.integers(0, 256, 1000).astype(np.uint8)
    state, want = 0, []
    for x in functions.tolist():
        want.append(state)
        state = (x >> (2 * state)) & 3
    assert B.states_before(functions).tolist() == want


def test_operators_round_trip(spark, odd, empty, clashing, oracle):
    texts = sorted((r[1] or "") for r in odd_rows())
    for docs in (odd, clashing):
        rows = B.encode(docs, PATH).collect()
        assert sorted(bytes(r.data).decode() for r in B.decode(B.encode(docs, PATH), PATH).collect()) == texts
        assert sorted(r.ids for r in rows) == sorted(oracle.encode_ordinary(t) for t in texts)
        assert all((r.ends[-1] if r.ends else 0) in {len(t.encode()) for t in texts} for r in rows)
    assert B.encode(empty, PATH).count() == 0 and B.round_trip(empty, PATH).count() == 0


def test_query_on_the_small_table(spark, tables, oracle):
    import hashlib
    from lacuna.llm.queries import QUERIES
    texts = {r[0]: r[1] or "" for r in tables("documents")}
    for r in QUERIES["op10_byte_bpe"](spark, SF).collect():
        ids = oracle.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
