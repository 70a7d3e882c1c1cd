"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text is reduced to the statistics named in ``FEATURES`` (character
classes, word shapes, repetition).  Trees are grown on a bounded sample of
labelled rows: features are cut into at most ``BINS`` quantile bins, gradient
and hessian sums per (node, feature, bin) pick the splits, and the complete
trees are flattened into arrays of (feature, threshold, leaf) that NumPy
traverses one depth at a time for all rows of a batch.

Scale: scoring is one pass over the text without a shuffle; the model is a few
tens of kilobytes in the task closure.  ``SAMPLE_ROWS`` bounds the rows that
reach the driver for fitting, at any input size.

Cases: null counts as empty; empty texts have all-zero statistics and get a
score like any other; labels that are null, or rows of one id with both labels
(the larger label is taken) never break the fit; without labels of both classes
the score is the share of label 1 (0.5 without labels); repeated rows score
alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import arrays as A

#: Labelled rows used for fitting, at most.
SAMPLE_ROWS = 16_384
BINS, DEPTH, ROUNDS, RATE, RIDGE = 64, 4, 150, 0.1, 1.0

FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "space", "newline", "high", "stop_marks",
            "odd_marks", "bang", "bar", "slash_at", "unique_words", "top_word", "same_next", "marked_words",
            "capital_words", "number_words", "short_words", "long_words", "longest_word", "unique_lines",
            "line_bytes", "repeated_pairs"]


def _class_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_UPPER = _class_table(bytes(range(65, 91)))
_LOWER = _class_table(bytes(range(97, 123)))
_DIGIT = _class_table(bytes(range(48, 58)))
_HIGH = _class_table(bytes(range(128, 256)))
_STOPS = _class_table(b".,;:?'\"()-")
_ODD = _class_table(b"#$%&*+<>=[]{}^_`~\\")
_BANG, _BAR, _SLASH = _class_table(b"!"), _class_table(b"|"), _class_table(b"/@")
_NEWLINE, _SPACE = _class_table(b"\n"), _class_table(A.SPACES)


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (c[offs[1:]] - c[offs[:-1]]).astype(float)


def _distinct_share(owner: np.ndarray, code: np.ndarray, n: np.ndarray, docs: int):
    """Per document: distinct codes / codes, and the most frequent code's share."""
    if len(code) == 0:
        return np.zeros(docs), np.zeros(docs)
    key = np.sort(owner * np.int64(int(code.max()) + 1) + code)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(head, len(key)))
    who = key[head] // np.int64(int(code.max()) + 1)
    distinct = np.bincount(who, minlength=docs).astype(float)
    top = np.zeros(docs)
    np.maximum.at(top, who, count)
    safe = np.maximum(n, 1)
    return distinct / safe, top / safe


def statistics(col: pa.Array) -> np.ndarray:
    """(rows, len(FEATURES)) statistics of a string column without nulls."""
    buf, offs = A.text_buffer(col)
    docs = len(offs) - 1
    size = np.diff(offs).astype(float)
    safe = np.maximum(size, 1)
    share = lambda t: _sums(t[buf], offs) / safe
    words, woffs = A.words_of(buf, offs)
    n = np.diff(woffs).astype(float)
    wsafe = np.maximum(n, 1)
    wbuf, wat = A.text_buffer(words)
    wlen = np.diff(wat)
    code, _ = A.coded(words)
    owner = np.repeat(np.arange(docs), np.diff(woffs))
    per_word = lambda flags: _sums(flags, woffs) / wsafe
    unique, top = _distinct_share(owner, code, n, docs)
    if len(code):
        last = wbuf[wat[1:] - 1]
        first = wbuf[wat[:-1]]
        inner = np.concatenate([owner[1:] == owner[:-1], [False]])
        same = np.concatenate([code[1:] == code[:-1], [False]]) & inner
        pair = code * np.int64(int(code.max()) + 1) + np.concatenate([code[1:], [0]])
        _, pair = np.unique(pair[inner], return_inverse=True)
        pairs, _ = _distinct_share(owner[inner], pair, np.maximum(n - 1, 0), docs)
        longest = np.zeros(docs)
        np.maximum.at(longest, owner, wlen)
        caps = _sums(_UPPER[wbuf], wat)
        digits = _sums(_DIGIT[wbuf], wat)
    else:
        last = first = np.zeros(0, np.uint8)
        same, pairs, longest = np.zeros(0, bool), np.zeros(docs), np.zeros(docs)
        caps = digits = np.zeros(0)
    breaks = np.flatnonzero(buf == 10)
    lines_at = np.unique(np.concatenate([breaks + 1, offs[:-1][size > 0]])) if len(buf) else np.zeros(0, np.int64)
    lines_at = lines_at[lines_at < len(buf)]
    if len(lines_at):
        lines = pa.BinaryArray.from_buffers(pa.binary(), len(lines_at), [
            None, pa.py_buffer(np.append(lines_at, len(buf)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
        line_code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        line_owner = np.searchsorted(offs, lines_at, "right") - 1
        n_lines = np.bincount(line_owner, minlength=docs).astype(float)
        unique_lines, _ = _distinct_share(line_owner, line_code, n_lines, docs)
    else:
        n_lines, unique_lines = np.zeros(docs), np.zeros(docs)
    return np.column_stack([
        np.log1p(size), np.log1p(n), _sums(np.ones(len(wbuf), np.uint8), np.append(wat[woffs[:-1]], len(wbuf))) / wsafe,
        share(_UPPER), share(_LOWER), share(_DIGIT), share(_SPACE), share(_NEWLINE), share(_HIGH), share(_STOPS),
        share(_ODD), share(_BANG), share(_BAR), share(_SLASH), unique, top, per_word(same),
        per_word((_ODD | _BANG | _BAR)[last]), per_word(_UPPER[first]), per_word(digits * 2 > wlen), per_word(wlen <= 2),
        per_word((wlen >= 16) & (caps < wlen)), np.log1p(longest), unique_lines, size / np.maximum(n_lines, 1), pairs])


# ------------------------------------------------------------------- the trees

class Trees:
    """Complete trees of one depth, flattened: inner nodes in breadth order."""

    def __init__(self, prior: float, feature, threshold, leaf):
        self.prior = prior
        self.feature, self.threshold, self.leaf = feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(f) and node[0:1].size and int(node.min()) < len(f):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Logistic boosting by gradient histograms."""
    n, p = x.shape
    share = float(y.mean()) if n else 0.5
    prior = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    inner = 2 ** depth - 1
    if n == 0 or share in (0.0, 1.0):
        return Trees(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = _edges(x)
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    flat = binned + np.arange(p) * BINS
    margin = np.full(n, prior)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        node = np.zeros(n, np.int64)
        f_arr, t_arr = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for d in range(depth):
            base, width = 2 ** d - 1, 2 ** d
            key = ((node - base)[:, None] * (p * BINS) + flat).ravel()
            size = width * p * BINS
            gs = np.bincount(key, np.repeat(g, p), size).reshape(width, p, BINS).cumsum(axis=2)
            hs = np.bincount(key, np.repeat(h, p), size).reshape(width, p, BINS).cumsum(axis=2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs ** 2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt ** 2 / (ht + RIDGE)
            gain[(hs < 1.0) | (ht - hs < 1.0)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f_arr[base + k], t_arr[base + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f_arr[node]] > t_arr[node])
        at = node - inner
        gl, hl = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = -RATE * gl / (hl + RIDGE)
        margin += leaf[at]
        features.append(f_arr), thresholds.append(t_arr), leaves.append(leaf)
    return Trees(prior, np.array(features), np.array(thresholds), np.array(leaves))


# ---------------------------------------------------------------- the operator

#: Bytes of text at once: the statistics hold several numbers for each byte.
SLICE_BYTES = 1 << 20


def held_out(id_col):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_rows(batches):
    for b in A.slices(batches, "text", SLICE_BYTES):
        x = statistics(A.text_column(b, "text"))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents outside the held-out
    fold; the sample is the first ones by a hash of the id."""
    known = (labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(target).cast("int").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(rows))
    # at most ``rows`` pairs of 12 bytes: a proven bound for the broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(known), "id")
    got = (sample.select("id", "y", "text").mapInArrow(_feature_rows, "id long, y int, x array<double>")
           .orderBy(F.xxhash64("id"), "id", "x").limit(rows).toPandas())
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit_trees(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of every row."""
    def kernel(batches):
        for b in A.slices(batches, "text", SLICE_BYTES):
            s = model.score(statistics(A.text_column(b, "text")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "doc_id long, score double")


def accepted(docs: DataFrame, model: Trees, threshold: float) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``threshold``, all columns."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index('text')}"

    def kernel(batches):
        for b in A.slices(batches, at, SLICE_BYTES):
            yield b.filter(pa.array(model.score(statistics(A.text_column(b, at))) >= threshold))

    return flat.mapInArrow(kernel, flat.schema).toDF(*names)
