"""Substring dedup: repeated windows of words, by super-k-mers.

A window is ``WINDOW`` consecutive words.  Its minimiser is the least hash of
its ``MER``-word runs; consecutive windows with one minimiser form a
super-k-mer, whose words are one packed string.  Equal windows have equal
minimisers, so all copies of a window meet in the minimiser's bucket, where
the windows of the packed strings are sorted and counted; equal hashes are
checked word by word.

What travels is cut down first without changing the result: super-k-mers are
announced by (minimiser, content hash, document).  A minimiser of one document
only is done.  Equal super-k-mers are one content, held by its least document;
every later holder loses the whole span at once.  Only contents whose
minimiser has several contents send a packed string, once, from the least
holder.  So a passage or text that is copied any number of times reaches its
bucket once.  Within a minimiser a content is named by a 64-bit hash.

A phrase that many texts share makes a minimiser with many contents.  Where
they are more than ``HOT``, their super-k-mers are cut again, by the least hash
of runs of ``LONG_MER`` words, so that only texts that share that much meet.
Buckets that are still crowded (a passage longer than that, within different
surroundings) send their windows as words, which are grouped as they are with
map-side minima.  All three ways compare words, and give the same spans.

Scale: announcements are 40 bytes for about 22 words; text moves once to cut
packed strings out of documents that need it, and once for documents that lose
words; buckets hold about ``BUCKET_ROWS`` strings of at most ``LONGEST``
windows.

Cases: null counts as no words; texts under ``WINDOW`` words lose nothing; a
null id sorts after all ids; rows of one id count as one document in the order
and do not remove words from each other, but each row is judged on its own
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import arrays as A
from lacuna.session import stage, unstage

WINDOW, MER, LONG_MER = 50, 8, 24
LONGEST = 64
HOT = 4_096
BUCKET_ROWS = 6_000
#: Parts that the marks of a repeated window are dealt to, and packed strings
#: that are cut into windows at a time.
SALTS, CUT_ROWS = 16, 400
_LAST = 9223372036854775807
#: An odd base and its inverse modulo 2 ** 64, for sums over word runs.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Sums:
    """Hashes of any run of words, from prefix sums of weighted word hashes."""

    def __init__(self, h: np.ndarray):
        weighted = h * _powers(_BASE, len(h))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
        self.undo = _powers(_INVERSE, len(h) + 1)

    def run(self, start: np.ndarray, length) -> np.ndarray:
        return A.mix((self.total[start + length] - self.total[start]) * self.undo[start] + np.asarray(length).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive items (len(x) - width + 1)."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def super_kmers(h: np.ndarray, woffs: np.ndarray):
    """(text, start in the text, windows, minimiser, content) of every
    super-k-mer, from word hashes and the texts' word offsets."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(h) < WINDOW:
        return none
    sums = Sums(h)
    mers = sums.run(np.arange(len(h) - MER + 1), MER)
    least = _sliding_min(mers, WINDOW - MER + 1)
    n = np.maximum(np.diff(woffs) - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    if not len(text):
        return none
    at = np.repeat(woffs[:-1], n) + A.runs(n)
    least = least[at]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (least[1:] != least[:-1])])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    # runs of one minimiser are cut at LONGEST windows
    cuts = -(-size // LONGEST)
    begin = np.repeat(head, cuts) + A.runs(cuts) * LONGEST
    windows = np.diff(np.append(begin, len(at)))
    first = at[begin]
    return (text[begin], first - woffs[text[begin]], windows, least[begin],
            sums.run(first, windows + WINDOW - 1))


_ROWS = ("key long, same long, start int, windows int, minimiser long, content long, n_words long, sha string")


def _announce(batches):
    """Super-k-mers of each text, and one row (windows 0) of the text itself."""
    for b in A.slices(batches, "text"):
        buf, offs = A.text_buffer(A.text_column(b, "text"))
        words, woffs = A.words_of(buf, offs)
        code, distinct = A.coded(words)
        text, start, windows, least, content = super_kmers(A.hashes(distinct)[code], woffs)
        data, at = A.text_buffer(words)
        shas = [_sha(data, at, s, e) for s, e in zip(woffs[:-1].tolist(), woffs[1:].tolist())]
        k, n = len(text), b.num_rows
        key, same = (np.concatenate([c.to_numpy(zero_copy_only=False)[i] for i in (text, np.arange(n))])
                     for c in (b.column(0), b.column(1)))
        zero = np.zeros(n, np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(key), pa.array(same), pa.array(np.concatenate([start, zero]).astype(np.int32)),
            pa.array(np.concatenate([windows, zero]).astype(np.int32)),
            pa.array(np.concatenate([least.view(np.int64), zero])), pa.array(np.concatenate([content.view(np.int64), zero])),
            pa.array(np.concatenate([np.zeros(k, np.int64), np.diff(woffs)])), pa.array([None] * k + shas, pa.string())],
            ["key", "same", "start", "windows", "minimiser", "content", "n_words", "sha"])


def _joined(data: np.ndarray, at: np.ndarray, start: int, end: int) -> bytes:
    """Words [start, end) joined by one space."""
    if end <= start:
        return b""
    piece = data[at[start]:at[end]]
    return np.insert(piece, at[start + 1:end] - at[start], 32).tobytes()


def _sha(data, at, start, end) -> str:
    return hashlib.sha256(_joined(data, at, start, end)).hexdigest()


_PACKED = "key long, same long, start int, minimiser long, longer long, packed binary"


def _second(h: np.ndarray) -> np.ndarray:
    return A.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def _recut(sums: Sums, first: int, n: int):
    """(offset, windows, least hash of ``LONG_MER`` words) of the parts of a
    super-k-mer of ``n`` windows that starts at word ``first``."""
    least = _sliding_min(sums.run(first + np.arange(n + WINDOW - LONG_MER), LONG_MER), WINDOW - LONG_MER + 1)
    head = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return zip(head.tolist(), np.diff(np.append(head, n)).tolist(), least[head].view(np.int64).tolist())


def _cut_out(batches):
    """Packed strings of the super-k-mers that a text must send; those of hot
    minimisers are cut by longer ones."""
    for b in A.slices(batches, "text"):
        buf, offs = A.text_buffer(A.text_column(b, "text"))
        words, woffs = A.words_of(buf, offs)
        code, distinct = A.coded(words)
        sums = Sums(A.hashes(distinct)[code])
        data, at = A.text_buffer(words)
        cols: list[list] = [[] for _ in range(6)]
        for i, (key, same, parts) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                                   b.column(2).to_pylist())):
            for p in parts:
                first = int(woffs[i]) + p["start"]
                cuts = _recut(sums, first, p["windows"]) if p["hot"] else [(0, p["windows"], 0)]
                for skip, n, longer in cuts:
                    packed = _joined(data, at, first + skip, first + skip + n + WINDOW - 1)
                    for c, v in zip(cols, (key, same, p["start"] + skip, p["minimiser"], longer, packed)):
                        c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                         ["key", "same", "start", "minimiser", "longer", "packed"])


def _each_window(batches):
    """The windows of packed strings, as words joined by one space."""
    spread = np.arange(WINDOW)
    for batch in batches:
        for k in range(0, batch.num_rows, CUT_ROWS):
            b = batch.slice(k, CUT_ROWS)
            words, woffs = A.words_of(*A.text_buffer(b.column(3)))
            n = np.diff(woffs) - WINDOW + 1
            row, step = np.repeat(np.arange(len(n)), n), A.runs(n)
            at = (woffs[:-1][row] + step)[:, None] + spread
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * WINDOW), words.take(pa.array(at.ravel())))
            start = b.column(2).to_numpy()[row] + step
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)),
                                              pa.array(start.astype(np.int32)), pc.binary_join(lists, " ")],
                                             ["key", "same", "start", "window"])


_SPAN = "key long, same long, low int, high int"


def _count_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans of a bucket's windows that a document with a smaller id has."""
    col = pa.array(pdf["packed"].tolist(), pa.binary())
    buf, offs = A.text_buffer(col)
    words, woffs = A.words_of(buf, offs)
    code, distinct = A.coded(words)
    h = A.hashes(distinct)[code]
    one, two = Sums(h), Sums(_second(h))
    n = np.diff(woffs) - WINDOW + 1
    row = np.repeat(np.arange(len(n)), n)
    at = np.repeat(woffs[:-1], n) + A.runs(n)
    h1, h2 = one.run(at, WINDOW), two.run(at, WINDOW)
    order = np.lexsort((h2, h1))
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    # equal hashes are checked word by word, a part at a time
    pairs = np.flatnonzero(same)
    spread = np.arange(WINDOW)
    for k in range(0, len(pairs), 20_000):
        p = pairs[k:k + 20_000]
        x, y = at[order[p]], at[order[p + 1]]
        equal = (code[x[:, None] + spread] == code[y[:, None] + spread]).all(axis=1)
        if not equal.all():   # a collision of 128 bits: sort by the words instead
            grid = code[at[:, None] + spread]
            order = np.lexsort(grid.T[::-1])
            same = (grid[order][1:] == grid[order][:-1]).all(axis=1)
            break
    key = pdf["key"].to_numpy()[row]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(key[order], head)
    lost = np.zeros(len(at), bool)
    lost[order] = key[order] > np.repeat(least, np.diff(np.append(head, len(at))))
    where = np.flatnonzero(lost)
    if not len(where):
        return pd.DataFrame({"key": [], "same": [], "low": [], "high": []}).astype("int64")
    new = np.concatenate([[True], (np.diff(where) != 1) | (row[where][1:] != row[where][:-1])])
    first, last = where[new], where[np.append(np.flatnonzero(new)[1:] - 1, len(where) - 1)]
    low = pdf["start"].to_numpy()[row[first]] + (at[first] - woffs[:-1][row[first]])
    return pd.DataFrame({"key": key[first], "same": pdf["same"].to_numpy()[row[first]], "low": low,
                         "high": low + (last - first) + WINDOW})


def _covered(n: int, spans) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["low"]] += 1
        edge[min(s["high"], n)] -= 1
    return np.cumsum(edge)[:n] > 0


def _kept_text(batches):
    """What is left of each text without the words in its spans."""
    for b in A.slices(batches, "text"):
        buf, offs = A.text_buffer(A.text_column(b, "text"))
        words, woffs = A.words_of(buf, offs)
        n, removed, kept = [], [], []
        for i, spans in enumerate(b.column(1).to_pylist()):
            size = int(woffs[i + 1] - woffs[i])
            gone = _covered(size, spans)
            left = words.slice(int(woffs[i]), size).filter(pa.array(~gone))
            n.append(size), removed.append(int(gone.sum())), kept.append(" ".join(left.to_pylist()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept"])


def _spans(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, same, low, high): all word spans that are to go."""
    found = rows.where("windows > 0").select("key", "same", "start", "windows", "minimiser", "content")
    contents = stage(found.groupBy("minimiser", "content").agg(F.min("key").alias("least"), F.max("key").alias("most")),
                     "contents")
    shared = (contents.groupBy("minimiser").agg(F.min("least").alias("k0"), F.max("most").alias("k1"),
                                                F.count(F.lit(1)).alias("kinds")).where("k0 < k1").select("minimiser", "kinds"))
    live = contents.join(shared, "minimiser").where("least < most or kinds > 1")
    held = stage(found.join(live.select("minimiser", "content", "least", "kinds"), ["minimiser", "content"])
                 .where("key > least or kinds > 1")
                 .select("key", "same", "start", "windows", "minimiser", (F.col("key") > F.col("least")).alias("later"),
                         (F.col("kinds") > HOT).alias("hot")), "held")
    whole = held.where("later").select("key", "same", F.col("start").alias("low"),
                                       (F.col("start") + F.col("windows") + (WINDOW - 1)).cast("int").alias("high"))
    sent = held.where("not later").groupBy("key", "same").agg(
        F.collect_list(F.struct("start", "windows", "minimiser", "hot")).alias("parts"))
    packed = stage(texts.join(sent, ["key", "same"]).select("key", "same", "parts", "text")
                   .mapInArrow(_cut_out, _PACKED), "packed")
    place = ["minimiser", "longer"]
    crowded = packed.where("longer != 0").groupBy(*place).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > HOT).drop("held")
    buckets = 1 + packed.count() // BUCKET_ROWS
    counted = (packed.join(crowded, place, "left_anti")
               .withColumn("bucket", F.pmod(F.xxhash64(*place), F.lit(buckets).cast("long")))
               .select("bucket", "key", "same", "start", "packed").groupBy("bucket").applyInPandas(_count_windows, _SPAN))
    windows = stage(packed.join(crowded, place, "left_semi").select("key", "same", "start", "packed")
                    .mapInArrow(_each_window, "key long, same long, start int, window string"), "windows")
    first = (windows.groupBy("window").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
             .select("window", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    dealt = (windows.withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)).cast("int"))
             .join(first, ["window", "salt"]).where("key > least")
             .select("key", "same", F.col("start").alias("low"), (F.col("start") + WINDOW).cast("int").alias("high")))
    out = stage(whole.unionByName(counted).unionByName(dealt), "spans")
    unstage(contents, held, packed, windows)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of every row; ``kept``
    is null where nothing is removed (the text is unchanged then)."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(key, F.xxhash64(text).alias("same"), text.alias("text"))
    rows = stage(texts.mapInArrow(_announce, _ROWS), "super_kmers")
    spans = _spans(texts, rows).groupBy("key", "same").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    changed = texts.join(spans, ["key", "same"]).select("key", "spans", "text").mapInArrow(
        _kept_text, "key long, n_words long, n_removed long, kept string")
    same = rows.where("windows = 0").join(spans.select("key", "same"), ["key", "same"], "left_anti")
    same = same.select("key", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept"),
                       F.col("sha").alias("kept_sha256"))
    changed = changed.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256))
    doc_id = F.when(F.col("key") != _LAST, F.col("key")).alias("doc_id")
    return same.unionByName(changed).select(doc_id, "n_words", "n_removed", "kept", "kept_sha256")
