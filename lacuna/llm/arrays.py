"""Vectorised helpers over Arrow text columns, shared by the operators.

Texts stay in their UTF-8 buffers: words are located by a byte class table,
hashed once per distinct word of a slice, and combined with NumPy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a kernel handles at once (one longer text goes alone).
SLICE_BYTES = 4 << 20

#: ASCII white space, \x20 and \x09 to \x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(SPACES)] = True
    return t


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


IS_SPACE = _space_table()
TO_LOWER = _lower_table()
EMPTY_WORDS = pa.array([], pa.string())


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column without nulls."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    offs = offs.astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None and offs[-1] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(batches, name: str, limit: int = SLICE_BYTES):
    """Record batches cut so that each holds about ``limit`` bytes of text."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, offs = text_buffer(text_column(b, name))
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
            end = min(max(end, start + 1), b.num_rows)
            yield b.slice(start, end - start)
            start = end


def words_of(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order (``[^\\x20\\x09-\\x0D]+``, or runs without
    the bytes ``between``), and the offsets of each text's words (n_texts + 1)."""
    if len(buf) == 0:
        return EMPTY_WORDS, np.zeros(len(offs), np.int64)
    solid = ~between[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offs[:-1][offs[1:] > offs[:-1]]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return EMPTY_WORDS, np.zeros(len(offs), np.int64)
    packed = buf[solid]
    at = np.cumsum(solid, dtype=np.int32)[starts] - 1
    woffs = np.append(at, len(packed)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(woffs), pa.py_buffer(packed))
    return words, np.searchsorted(starts, offs).astype(np.int64)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the words and the distinct words."""
    if len(words) == 0:
        return np.zeros(0, np.int64), EMPTY_WORDS
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """xxh64 of each string."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def runs(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... as one array."""
    total = int(n.sum())
    ends = np.cumsum(n)
    return np.arange(total) - np.repeat(ends - n, n)


def shingle_hashes(h: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles (a shorter, non-empty text gives
    its whole sequence) and their offsets; repeats are kept."""
    n = np.diff(woffs)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    soffs = np.concatenate([[0], np.cumsum(count)])
    if soffs[-1] == 0:
        return np.zeros(0, np.uint64), soffs
    at = np.repeat(woffs[:-1], count) + runs(count)
    width = np.repeat(np.minimum(n, k), count)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        w = h[np.minimum(at + j, len(h) - 1)]
        out = np.where(j < width, mix(out * np.uint64(0x9E3779B97F4A7C15) + w), out)
    return out, soffs


def utf8_strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())
