"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features of a text are its distinct lower-cased words, without the signs at
their ends, and the words' beginnings of ``PREFIXES`` characters.  On a bounded
labelled sample, features are screened by a chi-square test for association
with the toxic label.  The severity grade of a labelled row is 0 if it is not
toxic, and else 1, 2 or 3 by how many of its words are screened ones
(``CUTS``), as the labels themselves only know toxic or not.

The model is P(grade <= k) = s(t_k - w x) with one weight vector for all
ordered thresholds t_1 < t_2 < t_3, fitted by full-batch gradient steps with a
ridge penalty.  It yields the expected severity, the sum of P(grade > k), and
P(grade > 0), on which ``predicted`` rests.

Scale: feature counts are one aggregation with map-side sums; at most
``MAX_FEATURES`` screened features and ``SAMPLE_ROWS`` rows reach the driver;
scoring is one pass without a shuffle, looking up each distinct word of a
slice once.

Cases: null counts as empty; texts without any screened feature get the
intercept's score; null labels are skipped and an id with both labels counts
as toxic; without toxic rows every score is 0; repeated rows score alike;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import arrays as A

SAMPLE_ROWS = 16_384
MAX_FEATURES = 4_096
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Least rows with a feature, and its least chi-square statistic (1 degree).
LEAST_ROWS, CHI_SQUARE = 5, 25.0
#: Least numbers of screened words for grades 2 and 3.
CUTS = (2, 4)
STEPS, RATE, RIDGE = 600, 0.1, 2e-4


def features(word: str) -> list[str]:
    """The features of one word: itself, and its beginnings marked by ``^``."""
    w = word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    if not any(c.isalpha() for c in w):
        return []
    return [w] + ["^" + w[:k] for k in PREFIXES if len(w) >= k]


def _slice_features(col: pa.Array, table: dict[str, int] | None = None):
    """(owner, feature) pairs, distinct for each text, and the feature names
    (with ``table``: the places there, other features left out)."""
    buf, offs = A.text_buffer(col)
    words, woffs = A.words_of(buf, offs)
    code, distinct = A.coded(words)
    owner = np.repeat(np.arange(len(col)), np.diff(woffs))
    names: dict[str, int] = {} if table is None else table
    per, flat = np.zeros(len(distinct) + 1, np.int64), []
    for i, w in enumerate(distinct.to_pylist()):
        if table is None:
            got = [names.setdefault(f, len(names)) for f in features(w)]
        else:
            got = [k for f in features(w) if (k := table.get(f)) is not None]
        flat += got
        per[i + 1] = len(got)
    at, flat = np.cumsum(per), np.array(flat, np.int64)
    n = per[1:][code]
    who = np.repeat(owner, n)
    what = flat[np.repeat(at[code], n) + A.runs(n)] if len(flat) else np.zeros(0, np.int64)
    size = max(len(names), 1)
    pairs = np.unique(who * size + what)
    return pairs // size, pairs % size, list(names) if table is None else None


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def beyond(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        z = np.clip(margin[:, None] - self.thresholds[None, :], -40, 40)
        return 1.0 / (1.0 + np.exp(-z))


def fit_ordinal(owner, feature, grade: np.ndarray, size: int) -> Ordinal:
    """Gradient steps (with step sizes from running second moments) on the
    mean log-likelihood of the grades 0 to 3."""
    n, levels = len(grade), 3
    w, t, gap = np.zeros(size), 1.0, np.zeros(levels - 1)
    m, v = np.zeros(size + levels), np.zeros(size + levels)
    for step in range(1, STEPS + 1):
        thresholds = t + np.concatenate([[0.0], np.cumsum(np.exp(gap))])
        margin = np.bincount(owner, w[feature], n)
        p = Ordinal(w, thresholds).beyond(margin)                  # P(y > k)
        upper = np.column_stack([np.ones(n), p, np.zeros(n)])
        prob = np.maximum(upper[np.arange(n), grade] - upper[np.arange(n), grade + 1], 1e-12)
        slope = np.column_stack([np.zeros(n), p * (1 - p), np.zeros(n)])
        low, high = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        g_margin = (high - low) / prob / n                         # of minus the log-likelihood
        g_t = np.zeros(levels)
        np.add.at(g_t, np.maximum(grade - 1, 0), np.where(grade > 0, low / prob, 0.0) / n)
        np.add.at(g_t, np.minimum(grade, levels - 1), np.where(grade < levels, -high / prob, 0.0) / n)
        g_w = np.bincount(feature, g_margin[owner], size) + RIDGE * w
        g_gap = np.array([g_t[k + 1:].sum() * np.exp(gap[k]) for k in range(levels - 1)])
        g = np.concatenate([g_w, [g_t.sum()], g_gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, t, gap = w - move[:size], t - move[size], np.clip(gap - move[size + 1:], -6, 6)
    return Ordinal(w, t + np.concatenate([[0.0], np.cumsum(np.exp(gap))]))


class Model:
    def __init__(self, names: list[str], ordinal: Ordinal):
        self.table = {f: i for i, f in enumerate(names)}
        self.ordinal = ordinal

    def beyond(self, col: pa.Array) -> np.ndarray:
        owner, feature, _ = _slice_features(col, self.table)
        w = self.ordinal.weights
        margin = np.bincount(owner, w[feature] if len(w) else None, len(col)).astype(float)
        return self.ordinal.beyond(margin)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Model from at most ``rows`` labelled documents, the first by a hash of
    the id."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(rows))
    # at most ``rows`` pairs of 12 bytes: a proven bound for the broadcast
    sample = (docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(known), "id")
              .select("id", "y", "text"))

    def occurrences(batches):
        for b in A.slices(batches, "text"):
            owner, feature, names = _slice_features(A.text_column(b, "text"))
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
            n, toxic = np.bincount(feature, minlength=len(names)), np.bincount(feature, y, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()),
                                              pa.array(toxic.astype(np.int64))], ["feature", "n", "toxic"])

    total = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total[1] or total[0] == total[1]:
        constant = 40.0 if total[1] == 0 else -40.0
        return Model([], Ordinal(np.zeros(0), np.full(3, constant)))
    share = float(total[1]) / total[0]
    expected = F.col("n") * share
    counts = (sample.mapInArrow(occurrences, "feature string, n long, toxic long")
              .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
              .where((F.col("n") >= LEAST_ROWS) & (F.col("toxic") > expected))
              .withColumn("chi", F.pow(F.col("toxic") - expected, 2) / (expected * (1 - share)))
              .where(F.col("chi") >= CHI_SQUARE))
    names = [r["feature"] for r in counts.orderBy(F.desc("chi"), "feature").limit(MAX_FEATURES).collect()]
    table = {f: i for i, f in enumerate(names)}

    def found(batches):
        for b in A.slices(batches, "text"):
            owner, feature, _ = _slice_features(A.text_column(b, "text"), table)
            n = np.bincount(owner, minlength=b.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                                             pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "y", "x"])

    got = (sample.mapInArrow(found, "id long, y int, x array<int>").orderBy(F.xxhash64("id"), "id", "x")
           .limit(rows).toPandas())
    n = got["x"].map(len).to_numpy(np.int64)
    feature = np.concatenate([np.zeros(0, np.int64), *got["x"].tolist()]).astype(np.int64)
    owner = np.repeat(np.arange(len(got)), n)
    words = np.array([not f.startswith("^") for f in names], bool)
    strong = np.bincount(owner, words[feature] if len(names) else None, len(got))
    grade = np.where(got["y"].to_numpy() > 0, 1 + (strong >= CUTS[0]) + (strong >= CUTS[1]), 0).astype(np.int64)
    return Model(names, fit_ordinal(owner, feature, grade, max(len(names), 1)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, p_toxic) of every row."""
    def kernel(batches):
        for b in A.slices(batches, "text"):
            p = model.beyond(A.text_column(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array(np.ascontiguousarray(p[:, 0]))],
                                             ["doc_id", "severity", "p_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        kernel, "doc_id long, severity double, p_toxic double")
