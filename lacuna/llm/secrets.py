r"""Secret scans with multipart credential linking.

Base findings per kind, leftmost and non-overlapping over the whole text:

* ``assign``  a keyword, ``:`` or ``=``, and a value of 8 or more characters;
* ``access``  ``AKIA`` identifiers of 16 or more characters;
* ``hex``     runs of 32 or more characters of 0-9 and a-f.

Weak candidates are parts that mean little alone: ``ident`` (a user, login,
client or account name), ``bare`` (a run of 40 or more base64 characters of
three classes) and ``endpoint`` (a URL).  The parts of one text are sorted by
position and joined by interval: a part's scope is its span widened by
``REACH`` code points and cut at blank lines.  An ``ident`` is reported if a
secret (assign, hex, bare) overlaps its scope, a ``bare`` run if an identifier
(access, ident) or an endpoint does, an ``endpoint`` if both an identifier and
a secret do.

Scale: scopes never leave a text, so the scan is one pass without a shuffle.
Byte tables find the texts that hold a keyword, ``AKIA`` or a long run; only
these are matched in code points.  Memory is one slice of text.

Cases: null counts as empty; empty texts have no spans; overlapping spans of
different kinds are all reported and redacted together; repeated rows are
scanned alike; other columns pass through ``redact`` untouched (``n_chars``
follows the new text).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import arrays as A

#: Code points by which a part's scope exceeds its span on either side.
REACH = 240
BASE = ("assign", "access", "hex")
KINDS = BASE + ("ident", "bare", "endpoint")

# The base patterns (keywords in either case, ASCII only).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

IDENT = re.compile(r"""\b(?:user(?:name)?|login|client_id|account(?:_id)?|access_key_id)["']?\x20*[:=]\x20*["']?[\w@.-]{3,}""",
                   re.IGNORECASE | re.ASCII)
BARE = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
ENDPOINT = re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]{3,}""", re.ASCII)
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def _flags(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_HEX = _flags("0123456789abcdef")
_B64 = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def _long_runs(inside: np.ndarray, offs: np.ndarray, least: int) -> np.ndarray:
    """Starts of the runs of True with at least ``least`` items; a run ends
    where its text does."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    cut = np.unique(offs[(offs > 0) & (offs < len(inside))])
    cut = cut[inside[cut - 1] & inside[cut]]
    start = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
    end = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
    return start[end - start >= least]


def _suspects(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Indexes of the texts that can hold a base or a bare finding.  Words may
    cross into the next text here, which only adds suspects."""
    at = [_long_runs(_HEX[buf], offs, 32), _long_runs(_B64[buf], offs, 40)]
    for table, words in ((A.TO_LOWER[buf].tobytes(), STEMS), (buf.tobytes(), (b"AKIA",))):
        for w in words:
            i = table.find(w)
            while i >= 0:
                at.append(np.array([i]))
                # a word that crosses may overlap one that does not
                i = table.find(w, i + 1)
    return np.unique(np.searchsorted(offs, np.concatenate(at), "right") - 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


class _Parts:
    """Spans sorted by start, for overlap questions by binary search."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts = np.array([s[0] for s in spans], np.int64)
        self.ends = np.maximum.accumulate(np.array([s[1] for s in spans], np.int64)) if spans else np.zeros(0, np.int64)

    def overlap(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether any span meets the interval [low, high)."""
        if not len(self.starts):
            return np.zeros(len(low), bool)
        last = np.searchsorted(self.starts, high, "left") - 1
        return (last >= 0) & (self.ends[np.maximum(last, 0)] > low)


def _three_classes(s: str) -> bool:
    return any(c.islower() for c in s) and any(c.isupper() for c in s) and any(c.isdigit() for c in s)


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """All reported (start, end, kind) of a text, by start, then kind."""
    base = base_spans(text)
    taken = _Parts(base)

    def fresh(found):
        found = list(found)
        if not found:
            return found
        s, e = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        return [f for f, hit in zip(found, taken.overlap(s, e)) if not hit]

    bare = fresh((m.start(), m.end()) for m in BARE.finditer(text) if _three_classes(m[0]))
    if base or bare:
        ident = fresh((m.start(), m.end()) for m in IDENT.finditer(text))
        points = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)]
        secrets = _Parts([s[:2] for s in base if s[2] != "access"] + bare)
        idents = _Parts([s[:2] for s in base if s[2] == "access"] + ident)
        ends = _Parts(points)
        blanks = [m.start() for m in BLANK.finditer(text)]
        cuts = np.array([-1, *blanks, len(text) + 1], np.int64)

        def scopes(found):
            s, e = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
            block = np.searchsorted(cuts, s, "right")
            return np.maximum(s - REACH, cuts[block - 1]), np.minimum(e + REACH, cuts[np.minimum(block, len(cuts) - 1)])

        def linked(kind, found, rule):
            if not found:
                return []
            ok = rule(*scopes(found))
            return [(s, e, kind) for (s, e), hit in zip(found, ok) if hit]

        base += linked("ident", ident, secrets.overlap)
        base += linked("bare", bare, lambda lo, hi: idents.overlap(lo, hi) | ends.overlap(lo, hi))
        base += linked("endpoint", points, lambda lo, hi: idents.overlap(lo, hi) & secrets.overlap(lo, hi))
    return sorted(base, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _slice_spans(col: pa.Array) -> dict[int, list]:
    buf, offs = A.text_buffer(col)
    return {int(i): s for i in _suspects(buf, offs) if (s := spans_of(col[int(i)].as_py()))} if len(buf) else {}


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: spans are (start, end, kind) in code points."""
    def kernel(batches):
        for b in A.slices(batches, "text"):
            found = _slice_spans(A.text_column(b, "text"))
            rows = [[{"start": s, "end": e, "kind": k} for s, e, k in found.get(i, [])] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        kernel, "doc_id long, spans array<struct<start:bigint,end:bigint,kind:string>>")


def redacted(text: str, spans) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        if e <= at:
            continue
        if s >= at:
            out.append(text[at:s] + f"[{kind}]")
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span replaced by its kind in brackets; all
    rows and columns stay."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i = names.index(text_col)

    def kernel(batches):
        for b in A.slices(batches, f"c{i}"):
            col = A.text_column(b, f"c{i}")
            found = _slice_spans(col)
            if found:
                old = b.column(i)
                new = old.to_pylist()
                for k, spans in found.items():
                    new[k] = redacted(new[k], spans)
                b = b.set_column(i, b.schema.field(i), pa.array(new, old.type))
            yield b

    out = flat.mapInArrow(kernel, flat.schema).toDF(*names)
    if "n_chars" in names and text_col == "text":
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNotNull(), F.length(text_col))
                             .otherwise(F.col("n_chars")).cast(kind))
    return out
