r"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokenisation runs on arrays over a slice of text: code points are looked
up in a class table (letter, number, white space, other), and token starts
follow from neighbouring classes, apart from the contractions ('s 't 're 've
'm 'll 'd), whose end depends on how their apostrophe was reached.  These are
followed by an automaton of four states.  Each character is a transition
function of two bits per state (one byte), composition of two functions is one
look-up in a 256 x 256 table and is associative, so prefix compositions of
blocks are taken side by side and then chained.

The slices between token starts are dictionary-encoded without copying, and
only distinct slices reach the pair merges, where one round merges the
leftmost pair of lowest rank in every slice at once.  Results are cached for
the task.  Byte offsets of the tokens are kept for decoding.

Scale: one pass without a shuffle; the tables (pairs, classes) are fixed by
the vocabulary; memory is a slice of text, or one text if that is longer.

Cases: null counts as empty; an empty text has no tokens; white space at the
end of a text stays together; one very long slice is merged with a heap in
n log n; repeated rows encode alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import arrays as A

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Slices of more bytes are merged by the heap instead of in rounds.
LONG = 48
#: Distinct slices that a task's cache holds before it starts anew.
CACHE = 400_000
_NONE = np.int64(1) << 40


def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    t[WHITE_SPACE] = SPACE
    return t


class Ranks:
    """A rank file as arrays: token bytes, the byte tokens, and all pairs."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.size = max(ranks.values()) + 1
        by_rank = [b""] * self.size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.tokens = by_rank
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = np.array(merged, np.int64)[order]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's union, or ``_NONE``."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)


# ------------------------------------------------------- boundaries of slices

def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of valid UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    first = buf[at].astype(np.int32)
    if len(at) == len(buf):
        return first, at
    wide = np.concatenate([buf, np.zeros(3, np.uint8)])
    tail = lambda pos, k: (wide[pos + k] & 0x3F).astype(np.int32)
    cp = first.copy()
    for low, high, n in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
        k = np.flatnonzero((first >= low) & (first < high))
        if len(k):
            v = first[k] & (0x3F >> n)
            for j in range(1, n + 1):
                v = (v << 6) | tail(at[k], j)
            cp[k] = v
    return cp, at


# The automaton's states: ordinary, after an apostrophe that starts a slice,
# inside a contraction of two letters, after a contraction.
_PLAIN, _MARK, _HALF, _DONE = range(4)


def _pack(to) -> int:
    return sum(s << (2 * i) for i, s in enumerate(to))


_OF_ANY = _pack([_PLAIN, _PLAIN, _DONE, _PLAIN])
_OF_MARK = _pack([_MARK] * 4)
_OF_ONE = _pack([_PLAIN, _DONE, _DONE, _PLAIN])
_OF_FIRST = _pack([_PLAIN, _HALF, _DONE, _PLAIN])


def _compose_table() -> np.ndarray:
    """table[f * 256 + g] is the function "f, then g"."""
    f = np.arange(256)[:, None]
    g = np.arange(256)[None, :]
    out = np.zeros((256, 256), np.int64)
    for s in range(4):
        mid = (f >> (2 * s)) & 3
        out |= ((g >> (2 * mid)) & 3) << (2 * s)
    return out.astype(np.uint8).ravel()


COMPOSE = _compose_table()


def states_before(functions: np.ndarray) -> np.ndarray:
    """State before each character, from prefix compositions in blocks."""
    n = len(functions)
    if n == 0:
        return np.zeros(0, np.uint8)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    identity = _pack([0, 1, 2, 3])
    padded = np.full(blocks * width, identity, np.uint8)
    padded[:n] = functions
    f = np.ascontiguousarray(padded.reshape(blocks, width).T)
    prefix = np.empty_like(f)
    acc = np.full(blocks, identity, np.uint8)
    for j in range(width):
        prefix[j] = acc
        acc = COMPOSE[(acc.astype(np.uint16) << 8) | f[j]]
    entry, state = np.empty(blocks, np.uint8), _PLAIN
    for b, whole in enumerate(acc.tolist()):
        entry[b] = state
        state = (whole >> (2 * state)) & 3
    return ((prefix >> (2 * entry)) & 3).T.reshape(-1)[:n]


def slice_starts(cp: np.ndarray, heads: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Flags of the characters at which a slice starts.  ``heads`` flags the
    first character of each text."""
    n = len(cp)
    cls = classes[cp]
    ends = np.append(heads[1:], True)
    space = cls == SPACE
    blank = cp == 0x20
    new_run = np.empty(n, bool)
    new_run[0] = True
    new_run[1:] = cls[1:] != cls[:-1]
    new_run |= heads
    joined = np.zeros(n, bool)            # a character after a blank that it takes along
    joined[1:] = blank[:-1] & ~space[1:]
    joined &= ~heads
    start = new_run & ~joined
    last_space = space & ~ends            # the last white space before something else
    last_space[:-1] &= ~space[1:]
    start |= last_space
    # contractions
    nxt = np.append(cp[1:], 0) * ~ends
    mark = (cp == 0x27) & new_run & ~joined
    one = np.isin(cp, [0x73, 0x74, 0x6D, 0x64])
    first = ((cp == 0x72) | (cp == 0x76)) & (nxt == 0x65) | (cp == 0x6C) & (nxt == 0x6C)
    f = np.full(n, _OF_ANY, np.uint8)
    f[mark], f[one], f[first] = _OF_MARK, _OF_ONE, _OF_FIRST
    # a text's first character is entered in the ordinary state
    f[heads] = (f[heads] & 3) * 0x55
    before = states_before(f)
    before[heads] = _PLAIN
    start[(before == _MARK) & (one | first)] = False
    return start | (before == _DONE)


# ------------------------------------------------------------- merging slices

def merge_rounds(data: np.ndarray, offs: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many short slices, and their offsets."""
    n = len(offs) - 1
    sym = ranks.byte[data]
    owner = np.repeat(np.arange(n), np.diff(offs))
    done_sym, done_owner = [], []
    while len(sym):
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = ranks.pair(sym[inner], sym[inner + 1])
        while True:
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat((rank << 22) | np.arange(len(rank)), head)
            live = (low >> 22) < _NONE
            if not live.all():
                gone = np.repeat(~live, np.diff(np.append(head, len(sym))))
                done_sym.append(sym[gone]), done_owner.append(owner[gone])
                sym, owner, rank = sym[~gone], owner[~gone], rank[~gone]
                if not len(sym):
                    break
                continue
            at = low & ((1 << 22) - 1)
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))     # one symbol has gone from each slice before
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            touched = np.concatenate([at, at[at > 0] - 1])
            ok = touched + 1 < len(sym)
            ok[ok] = owner[touched[ok]] == owner[touched[ok] + 1]
            same, other = touched[ok], touched[~ok]
            rank[same] = ranks.pair(sym[same], sym[same + 1])
            rank[other] = _NONE
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return sym[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def merge_long(piece: bytes, byte: list, pairs: dict) -> list[int]:
    """Token ids of one slice by a heap over its pairs."""
    sym = [byte[b] for b in piece]
    n = len(sym)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := pairs.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], alive[j], right[i] = rank, False, right[j]
        if right[j] < n:
            left[right[j]] = i
            if (r := pairs.get((rank, sym[right[j]]))) is not None:
                heapq.heappush(heap, (r, i, rank, sym[right[j]]))
        if left[i] >= 0 and (r := pairs.get((sym[left[i]], rank))) is not None:
            heapq.heappush(heap, (r, left[i], sym[left[i]], rank))
    return [s for s, ok in zip(sym, alive) if ok]


class Encoder:
    """Encodes slices of texts; made once for each task."""

    def __init__(self, ranks: Ranks, classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self.vocabulary = pa.array(ranks.tokens, pa.binary())
        self.pairs = None
        self._clear()

    def _clear(self):
        self.known: dict[bytes, int] = {}
        self.ids, self.offs = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and their offsets."""
        whole = pc.index_in(pieces, value_set=self.vocabulary).to_numpy(zero_copy_only=False)
        known = ~np.isnan(whole.astype(float))
        size = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
        n = len(pieces)
        short = np.flatnonzero(~known & (size <= LONG))
        long_ = np.flatnonzero(~known & (size > LONG))
        ids, owner = [whole[known].astype(np.int64)], [np.flatnonzero(known)]
        for k in range(0, len(short), 50_000):
            part = short[k:k + 50_000]
            data, offs = A.text_buffer(pieces.take(pa.array(part)))
            got, at = merge_rounds(data, offs, self.ranks)
            ids.append(got), owner.append(np.repeat(part, np.diff(at)))
        if len(long_):
            if self.pairs is None:
                a, b = np.divmod(self.ranks.pair_keys, self.ranks.size)
                self.pairs = dict(zip(zip(a.tolist(), b.tolist()), self.ranks.pair_ranks.tolist()))
                self.byte = self.ranks.byte.tolist()
            for i in long_:
                got = merge_long(pieces[int(i)].as_py(), self.byte, self.pairs)
                ids.append(np.array(got, np.int64)), owner.append(np.full(len(got), i))
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])

    def _cached(self, pieces: pa.Array) -> np.ndarray:
        """Places of the distinct pieces in the cache."""
        words = pieces.to_pylist()
        if len(self.known) > CACHE:
            self._clear()
        fresh = np.flatnonzero([w not in self.known for w in words])
        if len(fresh):
            ids, at = self._merge(pieces.take(pa.array(fresh)))
            base = len(self.known)
            self.known.update((words[int(i)], base + k) for k, i in enumerate(fresh))
            self.offs = np.concatenate([self.offs, len(self.ids) + at[1:]])
            self.ids = np.concatenate([self.ids, ids])
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts and each text's offsets into them."""
        if len(buf) == 0:
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        cp, at = code_points(buf)
        heads = np.zeros(len(cp), bool)
        heads[np.searchsorted(at, offs[:-1][offs[1:] > offs[:-1]])] = True
        start = at[slice_starts(cp, heads, self.classes)]
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(start), [
            None, pa.py_buffer(np.append(start, len(buf)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
        d = pieces.dictionary_encode()
        place = self._cached(d.dictionary)[d.indices.to_numpy(zero_copy_only=False)]
        count = self.offs[place + 1] - self.offs[place]
        ids = self.ids[np.repeat(self.offs[place], count) + A.runs(count)]
        per_text = np.searchsorted(start, offs)
        return ids, np.concatenate([[0], np.cumsum(count)])[per_text]


class Decoder:
    """Token ids back to bytes, by the offsets of the vocabulary's bytes."""

    def __init__(self, ranks: Ranks):
        self.data = np.frombuffer(b"".join(ranks.tokens), np.uint8)
        self.size = np.array([len(t) for t in ranks.tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, byte offset of each token and the end)."""
        n = self.size[ids]
        return self.data[np.repeat(self.at[ids], n) + A.runs(n)], np.concatenate([[0], np.cumsum(n)])


# --------------------------------------------------------------- the operators

def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, ends): token ids and the byte offset at which each token
    of the text's UTF-8 ends.  ``path`` names the rank file."""
    ranks, classes = Ranks(path), class_table()

    def kernel(batches):
        encoder, decoder = Encoder(ranks, classes), Decoder(ranks)
        for b in A.slices(batches, "text"):
            buf, offs = A.text_buffer(A.text_column(b, "text"))
            ids, at = encoder.encode(buf, offs)
            ends = np.cumsum(decoder.size[ids]) - np.repeat(offs[:-1], np.diff(at))
            lists = lambda v: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists(ids), lists(ends)], ["doc_id", "ids", "ends"])

    return _texts(docs, id_col, text_col).mapInArrow(kernel, "doc_id long, ids array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, data): the bytes of each row's ids."""
    ranks = Ranks(path)

    def kernel(batches):
        decoder = Decoder(ranks)
        for b in batches:
            col = b.column(1)
            ids = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            data, at = decoder.decode(ids)
            offs = at[np.concatenate([[0], np.cumsum(n)])].astype(np.int64)
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offs), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column(0), out.cast(pa.binary())], ["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(kernel, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode`` and
    ``decode`` in one pass, digested."""
    ranks, classes = Ranks(path), class_table()

    def kernel(batches):
        encoder, decoder = Encoder(ranks, classes), Decoder(ranks)
        decimal = pa.array([str(i) for i in range(ranks.size)], pa.string())
        for b in A.slices(batches, "text"):
            buf, offs = A.text_buffer(A.text_column(b, "text"))
            ids, at = encoder.encode(buf, offs)
            said = pa.ListArray.from_arrays(pa.array(at, pa.int32()), decimal.take(pa.array(ids)))
            lines = pc.binary_join(said, " ").to_pylist()
            data, ends = decoder.decode(ids)
            cut = ends[at]
            data = data.tobytes()
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.diff(at), pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines], pa.string()),
                pa.array([hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(
        kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
