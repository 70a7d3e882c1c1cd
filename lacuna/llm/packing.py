"""Hierarchical multi-length packing of tokenised documents.

Every task tokenises its documents in a buffer of about ``BUFFER`` tokens and
packs the buffer hierarchically:

1. documents longer than the longest window give whole windows; the rest of a
   document is routed to the shortest tier (``TIERS``) that holds it;
2. tiers are packed from the longest on: each document opens a window, and the
   window's gap is filled with the longest documents of this or a shorter tier
   that fit in it; a gap that no whole document fits takes a cut of the next
   shorter document, whose rest is routed again;
3. documents of the shortest tier are laid end to end;
4. what fills no window stays for the next buffer; at the end of a task the
   last ids are laid into windows of powers of two, so nothing is padded.

Windows of one tier are dealt to step groups of ``STEP_TOKENS`` tokens, so that
each step of training has as many tokens whatever its window length.

Scale: no shuffle and no stage; memory is one buffer (and one text, if that is
longer).  The ids of a sequence come from its task alone, so a re-run task
writes the same sequences under the same ids.

Cases: null counts as empty and an empty text is its end id alone; very long
texts span windows; repeated rows are packed once each; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import arrays as A

TIERS = (512, 1024, 2048, 4096)
BUFFER = 1 << 19
STEP_TOKENS = 1 << 16
#: Distinct words that a task's cache holds before it starts anew.
CACHE = 400_000

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_id long")


#: Words of these characters alone are normal (NFC) as they are, and lower
#: letter by letter; other words go through the whole tokenizer.
_PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]*")


def spec_of(path: str) -> tuple[str | None, list[str]]:
    """The pattern of pieces (None for a file of another make) and the special
    tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as text:
        spec = json.load(text)
    kinds = lambda part, many: [x["type"] for x in (spec[part] or {}).get(many, [])]
    plain = kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and \
        kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if plain else None
    return pattern, [t["content"] for t in spec["added_tokens"]]


#: What a pattern must not have if texts are to be cut together: groups that
#: look around, anchors.
_LOOKS = re.compile(r"\(\?[^:]|\$|(?<!\[)\^|\\[bBAzZGmMK]")


def _byte_level() -> dict[int, int]:
    """The letters that byte-level tokenizers write bytes as."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {**{b: b for b in own}, **{b: 256 + k for k, b in enumerate(others)}}


_BYTE_LEVEL = _byte_level()


def _strings(distinct: pa.Array) -> list[str]:
    """The values of a string column (``to_pylist`` makes a scalar of each first)."""
    return distinct.to_numpy(zero_copy_only=False).tolist()


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and the length of each."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), n


class WordTokens:
    """Token ids of texts from a word-level tokenizer file: white space is
    dropped and words never merge, so each distinct word is encoded once.

    Plain words are cut together into the pieces of the file's own pattern, and
    each distinct piece goes to the merges alone; a file of another make than NFC,
    lower case and byte-level pieces takes the whole tokenizer throughout."""

    def __init__(self, path: str, spec: tuple[str | None, list[str]] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        pattern, self.specials = spec or spec_of(path)
        self.pattern = regex.compile(pattern).findall if pattern is not None else None
        # words are cut together, an end of line behind each, unless the pattern looks around
        self.cut = regex.compile(f"(?:{pattern})|\n").findall if pattern is not None and _LOOKS.search(pattern) is None else None
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        # the end of line between words that are cut together has no ids
        self.pieces: dict[str, int] = {"\n": 0}
        self.piece_ids, self.piece_offs = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.ids, self.offs = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _piece_places(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of each piece are; numbers and flat arrays alone are
        kept, which Python's collector need not visit."""
        fresh = list(dict.fromkeys(p for p in pieces if p not in self.pieces))
        if fresh:
            ids, n, tokenize = [], [], self.model.tokenize
            for p in fresh:
                got = tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LEVEL))
                n.append(len(got))
                ids += [t.id for t in got]
            base = len(self.pieces)
            self.pieces.update(zip(fresh, range(base, base + len(fresh))))
            self.piece_offs = np.concatenate([self.piece_offs, len(self.piece_ids) + np.cumsum(n)])
            self.piece_ids = np.concatenate([self.piece_ids, np.array(ids, np.uint32)])
        return np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))

    def _plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, one word after the other, and the number of each."""
        place = upto = None
        if self.cut is not None:
            code, distinct = A.coded(pa.array(self.cut("\n".join([*words, ""]).lower()), pa.string()))
            place = self._piece_places(_strings(distinct))[code]
            upto = np.flatnonzero(place == 0) + 1
        if upto is None or len(upto) != len(words):
            pieces = [self.pattern(w.lower()) for w in words]
            place = self._piece_places(list(chain.from_iterable(pieces)))
            upto = np.cumsum([len(p) for p in pieces])
        first, n = self.piece_offs[place], self.piece_offs[place + 1] - self.piece_offs[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(first - ends[:-1], n)
        at += np.arange(len(at))
        return self.piece_ids[at], np.diff(ends[upto], prepend=0)

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self._clear()
        fresh = [w for w in words if w not in self.known]
        if fresh:
            plain = _PLAIN.fullmatch
            simple = [self.pattern is not None and plain(w) is not None and not ("<|" in w and any(s in w for s in self.specials))
                      for w in fresh]
            here, rest = list(compress(fresh, simple)), [w for w, s in zip(fresh, simple) if not s]
            ids, n = self._plain_ids(here) if here else _flat([])
            if rest:
                more, m = _flat([e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)])
                ids, n = np.concatenate([ids, more]), np.concatenate([n, m])
            base = len(self.known)
            self.known.update(zip(chain(here, rest), range(base, base + len(fresh))))
            self.offs = np.concatenate([self.offs, len(self.ids) + np.cumsum(n)])
            self.ids = np.concatenate([self.ids, ids])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, col: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, and their offsets."""
        buf, offs = A.text_buffer(col)
        words, woffs = A.words_of(buf, offs)
        code, distinct = A.coded(words)
        place = self._places(_strings(distinct))
        first, n = self.offs[place][code].astype(np.int32), (self.offs[place + 1] - self.offs[place])[code].astype(np.int32)
        # the end of a text is one more word, found behind all others
        first = np.insert(first, woffs[1:], np.int32(len(self.ids)))
        n = np.insert(n, woffs[1:], np.int32(1))
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat(first - (ends - n), n)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.append(self.ids, np.uint32(end_id))[at]
        return ids, np.concatenate([[0], ends[woffs[1:] + np.arange(len(woffs) - 1)]])


class Pool:
    """Pieces (text, start, length) by tier; the longest that fits a gap is
    taken first, pieces of one length in the order they came.  ``held`` has the
    ids of each tier."""

    def __init__(self, tiers):
        self.tiers = tiers
        self.by_length: list[dict[int, list]] = [{} for _ in tiers]
        self.lengths: list[list[int]] = [[] for _ in tiers]
        self.tokens = 0
        self.held = [0] * len(tiers)

    def add(self, piece) -> None:
        import bisect
        k = bisect.bisect_left(self.tiers, piece[2])
        held = self.by_length[k].setdefault(piece[2], [])
        if not held:
            bisect.insort(self.lengths[k], piece[2])
        held.append(piece)
        self.tokens += piece[2]
        self.held[k] += piece[2]

    def _take(self, k: int, at: int):
        length = self.lengths[k][at]
        held = self.by_length[k][length]
        piece = held.pop()
        if not held:
            self.lengths[k].pop(at)
        self.tokens -= length
        self.held[k] -= length
        return piece

    def longest(self, tier: int):
        """The longest piece of a tier, or None."""
        return self._take(tier, -1) if self.lengths[tier] else None

    def fitting(self, gap: int, tier: int):
        """The longest piece of at most ``gap`` ids from ``tier`` or below."""
        import bisect
        for k in range(tier, -1, -1):
            at = bisect.bisect_right(self.lengths[k], gap) - 1
            if at >= 0:
                return self._take(k, at)
        return None

    def shortest(self, tier: int):
        """The shortest piece from ``tier`` or below, or None."""
        for k in range(tier + 1):
            if self.lengths[k]:
                return self._take(k, 0)
        return None


def worker_tokens(path: str, spec) -> WordTokens:
    """The tokens of a file, kept for the tasks that follow in this worker."""
    import tokenizers
    held = tokenizers.__dict__.setdefault("_words_by_path", {})
    if path not in held:
        held.clear()
        held[path] = WordTokens(path, spec)
    return held[path]


def windows(pool: Pool, last: bool):
    """Full windows (tier, pieces) from a pool; at the end of the input also
    windows of the remaining powers of two."""
    for tier in range(len(pool.tiers) - 1, -1, -1):
        size = pool.tiers[tier]
        while True:
            # a window is opened only if this and the shorter tiers fill it
            if sum(pool.held[:tier + 1]) < size or (piece := pool.longest(tier)) is None:
                break
            filled, gap = [piece], size - piece[2]
            while gap:
                piece = pool.fitting(gap, tier)
                if piece is None:
                    text, start, n = pool.shortest(tier)
                    piece = (text, start, gap)
                    pool.add((text, start + gap, n - gap))
                filled.append(piece)
                gap -= piece[2]
            yield size, filled
    if last and pool.tokens:
        left = []
        while (piece := pool.shortest(len(pool.tiers) - 1)) is not None:
            left.append(piece)
        size = 1 << (sum(p[2] for p in left).bit_length() - 1)
        while left:
            total = sum(p[2] for p in left)
            while size > total or size > pool.tiers[-1]:
                size >>= 1
            filled, gap = [], size
            while gap:
                text, start, n = left.pop()
                if n > gap:
                    left.append((text, start + gap, n - gap))
                    n = gap
                filled.append((text, start, n))
                gap -= n
            yield size, filled


def _packer(tokens: WordTokens, end_id: int, tiers, step_tokens: int):
    """State of one task: feeds texts, gives piece rows."""
    pool, texts = Pool(tiers), {}
    count, step_of, next_step, base = [0], {}, [0], TaskContext.get().partitionId() << 32

    def step(size: int) -> int:
        held = step_of.get(size)
        if held is None or held[1] + size > step_tokens:
            held = step_of[size] = [next_step[0], 0]
            next_step[0] += 1
        held[1] += size
        return base + held[0]

    def rows(found):
        for size, pieces in found:
            sequence, offset, group = base + count[0], 0, step(size)
            count[0] += 1
            for text, start, n in pieces:
                entry = texts[text]
                doc_id, ids = entry[0], entry[1]
                yield (doc_id, start, n, ids[start:start + n].astype("<u4").tobytes(), len(ids), sequence, offset,
                       size, group)
                offset += n
                entry[2] -= n
                if not entry[2]:
                    del texts[text]

    def feed(doc_ids, col: pa.Array):
        ids, at = tokens.encode(col, end_id)
        top = tiers[-1]
        for doc_id, s, e in zip(doc_ids, at[:-1].tolist(), at[1:].tolist()):
            key = count_texts[0]
            count_texts[0] += 1
            texts[key] = [doc_id, ids[s:e].copy(), e - s]
            full = (e - s) // top * top
            yield from rows((top, [(key, k, top)]) for k in range(0, full, top))
            if e - s > full:
                pool.add((key, full, e - s - full))
        if pool.tokens >= BUFFER:
            yield from rows(windows(pool, False))

    count_texts = [0]
    return feed, lambda: rows(windows(pool, True))


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()),
                    ("step_id", pa.int64())])


def pack(docs: DataFrame, path: str, end_id: int = 2, tiers=TIERS, step_tokens: int = STEP_TOKENS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document's ids [start, start + length) as
    little-endian unsigned 32-bit integers lie at ``offset`` of a sequence."""
    tiers, spec = tuple(tiers), spec_of(path)

    def kernel(batches):
        feed, finish = _packer(worker_tokens(path, spec), end_id, tiers, step_tokens)

        def as_batches(rows):
            rows = list(rows)
            for k in range(0, len(rows), 4096):
                cols = zip(*rows[k:k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

        for b in A.slices(batches, "text"):
            yield from as_batches(feed(b.column(0).to_pylist(), A.text_column(b, "text")))
        yield from as_batches(finish())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, PIECES)
