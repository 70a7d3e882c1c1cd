"""Ranked lexical search with a K2-treap over the term-document grid.

Documents are dealt to shards of about ``SHARD_POSTINGS`` cells.  A shard is a
grid: its terms are rows (by falling document frequency), its documents are
columns (by rising id), and a cell holds the impact of a term in a document.
The grid is a compressed quadtree: the four children of a node are four bits,
a child's number is the rank of its bit, and each node stores how much less
than its parent's its largest impact is.

An item descends with one path for each of its terms.  A state is a range of
documents with the nodes that cover this range in the rows of the terms; the
weighted sum of their maxima bounds the score of every document in it.  The
states with the best bounds are split first, ``BATCH`` at a time, until no
state can reach the shard's k best.  At a range of one document the bound is
the score.  All arithmetic is in 64-bit integers, so the bounds are exact.

Scale: one pass makes the grids, whose sums give the counts of the corpus; the
second builds the treaps, and a third searches them.  Shards never meet; each
gives its k best for each item, which a window limited on both sides of the
shuffle reduces.  Items are a stated query set: they are read in blocks of
``ITEM_BLOCK`` items or ``ITEM_BYTES`` bytes, and each block meets all shards.
The document frequencies of a block's terms alone reach the driver.

Cases: null texts and texts without a term have no cells and are not counted;
null ids come after all others and show null; equal scores go by rising id;
rows that repeat an id and a text are documents of their own; a document
longer than a shard is a shard of its own; items without a term in any
document, and empty tables, give no rows; texts of items with one id are one
item; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm import arrays as A
from lacuna.session import stage

SHARD_POSTINGS = 1 << 20
ITEM_BLOCK, ITEM_BYTES = 4_096, 8 << 20
#: States that are split at a time.
BATCH = 32
#: The ranking's constants (saturation 1.2, length share 25 of 100).
SCALE, FLAT, SHARE, SATURATE = 1_000_000_000, 75, 25, 12
_LAST = 9223372036854775807


def _between() -> np.ndarray:
    """Bytes that are part of no term: ASCII but for digits and letters."""
    t = np.zeros(256, bool)
    t[:128] = True
    for low, high in ((48, 58), (65, 91), (97, 123)):
        t[low:high] = False
    return t


BETWEEN = _between()


def terms_of(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, A to Z lower-cased, and their offsets."""
    buf, offs = A.text_buffer(col)
    return A.words_of(A.TO_LOWER[buf], offs, BETWEEN)


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - SHARE + (SHARE * lengths * n_docs) // n_terms
    return (SCALE * tf) // (1000 * tf + SATURATE * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --------------------------------------------------------------------- grids

_GRID = "ids array<long>, lengths array<long>, terms binary, df binary, cells binary, docs long, total long"
_CODEC = "zstd"


def _packed(a: np.ndarray | bytes) -> bytes:
    """A blob with its length before the compressed bytes."""
    raw = a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpacked(blob, kind: str = "<u4") -> np.ndarray:
    raw = blob.as_buffer()
    size = int.from_bytes(raw[:8].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=size, codec=_CODEC), kind)


def _vocabulary(blob) -> pa.Array:
    """The terms of a shard, in the order of its rows."""
    text = _unpacked(blob, np.uint8)
    ends = np.flatnonzero(text == 10)
    offs = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offs), pa.py_buffer(text[text != 10]))


def _cells(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(document, term code, occurrences), distinct terms, lengths of texts."""
    words, woffs = terms_of(col)
    code, distinct = A.coded(words)
    lengths = np.diff(woffs)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    key, tf = np.unique(doc * max(len(distinct), 1) + code, return_counts=True)
    return key // max(len(distinct), 1), key % max(len(distinct), 1), tf, distinct, lengths


def _grid(parts: list) -> pa.RecordBatch:
    """One shard from the cells of several slices."""
    ids = pa.concat_arrays([p[0] for p in parts])
    lengths = np.concatenate([p[1][4] for p in parts])
    vocabulary = pa.concat_arrays([p[1][3].cast(pa.string()) for p in parts]).dictionary_encode()
    at = vocabulary.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    docs_before = np.cumsum([0, *[len(p[1][4]) for p in parts]])
    words_before = np.cumsum([0, *[len(p[1][3]) for p in parts]])
    doc = np.concatenate([p[1][0] + b for p, b in zip(parts, docs_before)])
    term = np.concatenate([at[p[1][1] + b] for p, b in zip(parts, words_before)])
    tf = np.concatenate([p[1][2] for p in parts])
    # columns by id (nulls last), without the documents that have no term
    some = np.flatnonzero(lengths > 0)
    order = some[np.argsort(pc.fill_null(ids, _LAST).to_numpy(zero_copy_only=False)[some], kind="stable")]
    column = np.empty(len(lengths), np.int64)
    column[order] = np.arange(len(order))
    df = np.bincount(term, minlength=len(vocabulary.dictionary))
    by_df = np.argsort(-df, kind="stable")
    row = np.empty(len(df), np.int64)
    row[by_df] = np.arange(len(df))
    cells = np.stack([row[term], column[doc], tf]).astype("<u4")
    names = vocabulary.dictionary.take(pa.array(by_df))
    listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    # no term holds a line end
    text = "".join(f"{t}\n" for t in names.to_pylist()).encode()
    return pa.RecordBatch.from_arrays(
        [listed(ids.take(pa.array(order))), listed(pa.array(lengths[order], pa.int64())),
         *[pa.array([_packed(v)], pa.binary()) for v in (text, df[by_df].astype("<u4"), cells)],
         pa.array([len(order)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())],
        ["ids", "lengths", "terms", "df", "cells", "docs", "total"])


def grids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row for each shard of documents."""
    def kernel(batches):
        held, size = [], 0
        for b in A.slices(batches, "text"):
            part = (b.column(0), _cells(A.text_column(b, "text")))
            held.append(part)
            size += len(part[1][2])
            if size >= shard_postings:
                yield _grid(held)
                held, size = [], 0
        if size:
            yield _grid(held)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, _GRID)


# -------------------------------------------------------------------- treaps

def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers at every second place."""
    x = x.astype(np.uint64)
    # fixed values: the masks of the doubling steps
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def treap(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(height, child bits, maxima below the parents') in breadth-first order;
    the root's own maximum comes first."""
    height = max(int(row.max()).bit_length(), int(column.max()).bit_length(), 1)
    code = _spread(row) * np.uint64(2) + _spread(column)
    order = np.argsort(code)
    code, value = code[order], value[order]
    bits, less = [], []
    for _ in range(height):
        parent = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
        top = np.maximum.reduceat(value, first)
        child = np.zeros(4 * len(first), bool)
        child[4 * own + (code & np.uint64(3)).astype(np.int64)] = True
        bits.append(child)
        less.append(top[own] - value)
        code, value = parent[first], top
    return height, np.concatenate(bits[::-1]), np.concatenate([value, *less[::-1]])


#: Set bits of each byte.
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


class Treap:
    """A quadtree that is read through ranks: the k-th set bit is node k, the
    root is node 0.  ``packed`` holds eight child bits in a byte."""

    def __init__(self, height: int, n_bits: int, packed: np.ndarray, less: np.ndarray):
        self.height, self.packed = height, packed
        ones = _ONES[packed]
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        children = np.stack([_ONES[packed >> 4], _ONES[packed & 15]], axis=1).ravel()[:n_bits // 4]
        self.top = less.astype(np.int32)
        start, end, first = 0, 1, 1
        while first < len(less):
            # nodes of a level are numbered in the order of their parents
            last = first + int(children[start:end].sum())
            self.top[first:last] = np.repeat(self.top[start:end], children[start:end]) - self.top[first:last]
            start, end, first = first, last, last

    def child(self, place: np.ndarray) -> np.ndarray:
        """The node behind each child bit, or -1."""
        byte, bit = place >> 3, (place & 7).astype(np.uint8)
        held = self.packed[byte]
        node = self.before[byte] + _ONES[held >> (7 - bit)]
        return np.where((held >> (7 - bit)) & 1, node, -1)

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the k best, equal scores by column."""
        h = self.height
        bound, start = np.array([(int(self.top[0]) * weights).sum()]), np.zeros(1, np.int64)
        level, nodes = np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            pick = np.lexsort((start, -bound))[:BATCH]
            rest = np.ones(len(bound), bool)
            rest[pick] = False
            at, depth = start[pick], level[pick]
            # children of both halves of each range, in the rows' own halves
            shift = h - 1 - depth
            bit = 4 * nodes[pick] + 2 * ((rows[None, :] >> shift[:, None]) & 1)
            dead = nodes[pick] < 0
            halves = []
            for half in (0, 1):
                halves.append(np.where(dead, -1, self.child(np.where(dead, 0, bit + half))))
            child = np.concatenate(halves)
            reach = (np.where(child < 0, 0, self.top[child]) * weights).sum(axis=1)
            begin = np.concatenate([at, at + (1 << shift)])
            deep = np.concatenate([depth, depth]) + 1
            leaf = (deep == h) & (reach > 0)
            if leaf.any():
                best, score = np.concatenate([best, begin[leaf]]), np.concatenate([score, reach[leaf]])
                order = np.lexsort((best, -score))[:k]
                best, score = best[order], score[order]
            grow = (deep < h) & (reach > 0)
            bound = np.concatenate([bound[rest], reach[grow]])
            start = np.concatenate([start[rest], begin[grow]])
            level = np.concatenate([level[rest], deep[grow]])
            nodes = np.concatenate([nodes[rest], child[grow]])
            if len(best) == k:
                alive = (bound > score[-1]) | ((bound == score[-1]) & (start < best[-1]))
                bound, start, level, nodes = bound[alive], start[alive], level[alive], nodes[alive]
        return best, score


def index(shards: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The treap of each shard: child bits, eight to a byte, and by how much
    each maximum lies below its parent's, compressed."""
    def kernel(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                row, column, tf = _unpacked(one.column(2)[0]).reshape(3, -1)
                value = impacts(tf.astype(np.int64), one.column(3)[0].values.to_numpy()[column], n_docs, n_terms)
                height, bits, less = treap(row, column, value)
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), one.column(1), pa.array([height], pa.int32()), pa.array([len(bits)], pa.int64()),
                     pa.array([_packed(np.packbits(bits))], pa.binary()), pa.array([_packed(less.astype("<u4"))], pa.binary())],
                    ["ids", "terms", "height", "n_bits", "bits", "less"])
                del row, column, tf, value, bits, less
                pa.default_memory_pool().release_unused()

    return shards.select("ids", "terms", "cells", "lengths").mapInArrow(
        kernel, "ids array<long>, terms binary, height int, n_bits long, bits binary, less binary")


# -------------------------------------------------------------------- search

def _found_in(items: list, weights: dict, k: int):
    """Each shard's k best for the items (name, {term: count})."""
    names = [name for name, _ in items]

    def kernel(batches):
        asked = pa.array(sorted(weights), pa.string())
        for b in batches:
            for i in range(b.num_rows):
                ids, terms, height, n_bits, bits, less = (c[0] for c in b.slice(i, 1).columns)
                place = pc.index_in(asked, value_set=_vocabulary(terms)).to_numpy(zero_copy_only=False)
                row_of = {t: int(r) for t, r in zip(asked.to_pylist(), place) if r == r}
                t = Treap(height.as_py(), n_bits.as_py(), _unpacked(bits, np.uint8), _unpacked(less))
                who, column, score = [], [], []
                for slot, (_, terms_asked) in enumerate(items):
                    own = [(row_of[w], n * weights[w]) for w, n in terms_asked.items() if w in row_of and weights[w] > 0]
                    if own:
                        rows, factors = np.array(own, np.int64).T
                        at, s = t.search(rows, factors, k)
                        who.append(np.full(len(at), slot)), column.append(at), score.append(s)
                if who:
                    slots = np.concatenate(who)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[s] for s in slots], pa.string()), ids.values.take(pa.array(np.concatenate(column))),
                         pa.array(np.concatenate(score))], ["item", "doc_id", "score"])
    return kernel


def _frequencies(asked: list[str]):
    """(term, df) of the asked terms in each shard."""
    def kernel(batches):
        names = pa.array(asked, pa.string())
        for b in batches:
            for i in range(b.num_rows):
                place = pc.index_in(names, value_set=_vocabulary(b.column(0)[i]))
                some = place.is_valid()
                df = _unpacked(b.column(1)[i])[place.filter(some).to_numpy()]
                yield pa.RecordBatch.from_arrays([names.filter(some), pa.array(df.astype(np.int64))], ["term", "df"])
    return kernel


def _blocks(items: DataFrame, item_col: str, text_col: str):
    """The items in blocks of a stated size, as (name, {term: count})."""
    whole = items.groupBy(F.col(item_col).cast("string").alias("item")).agg(
        F.array_join(F.array_sort(F.collect_set(text_col)), " ").alias("text"))
    n, size = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEM_BLOCK), -(-size // ITEM_BYTES))
    for k in range(blocks):
        part = whole if blocks == 1 else whole.where(F.pmod(F.xxhash64("item"), F.lit(blocks).cast("long")) == k)
        rows = part.orderBy("item").collect()  # one block: a stated bound
        words, offs = terms_of(pa.array([r.text for r in rows], pa.string()))
        yield [(r.item, dict(Counter(words[s:e].to_pylist()))) for r, s, e in zip(rows, offs[:-1].tolist(), offs[1:].tolist()) if e > s]


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    shards = stage(grids(docs, id_col, text_col, shard_postings), "grids")
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    treaps, found = None, None
    for block in _blocks(items, item_col, item_text):
        asked = sorted({w for _, terms in block for w in terms})
        if not asked or not n_docs:
            continue
        treaps = treaps or stage(index(shards, n_docs, n_terms), "treaps")
        df = (shards.select("terms", "df").mapInArrow(_frequencies(asked), "term string, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).collect())  # the terms of one block
        weights = {r.term: weight(r.df, n_docs) for r in df}
        part = treaps.mapInArrow(_found_in([(name, {w: n for w, n in t.items() if w in weights}) for name, t in block], weights, k),
                                 "item string, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item string, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("item").cast(dict(items.dtypes)[item_col]).alias("item_id"), "rank", "doc_id", "score"))
