"""Exact dedup through a minimal perfect hash over historical digests.

A corpus generation that is already known (the history) is reduced to its
distinct SHA-256 digests.  They are dealt to shards by their leading bytes,
and each shard becomes one minimal perfect hash: levels of a bit array in
which a digest owns a bit if no other digest of its level hashes there (the
rest go to the next level); the rank of its bit is its slot.  Slots hold the
full 32-byte digest, the winner's id and the number of rows, so that a lookup
compares bytes and a non-member is never taken for a member.

A batch is reduced to its distinct digests before any lookup: members of the
history take its winner, the others group among themselves.

Scale: texts never shuffle, only (id, digest) pairs do.  Groups of copies are
pre-aggregated by (digest, salt) and joined back by (digest, salt), so a group
with a third of all rows is spread over ``SALTS`` keys.  A shard holds about
``SHARD_ROWS`` digests at any input size, as SHA-256 spreads them evenly.

Cases: null text counts as empty; a null id sorts after every other id and
wins only a group without ids; equal texts whose smallest id occurs in several
rows show all rows of that id as kept, of which ``kept_rows`` keeps one; a very
long text is hashed in the JVM and never moved; an empty table gives an empty
result; other columns pass through ``kept_rows`` untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.survivors import survivors
from lacuna.session import stage

SHARD_ROWS = 50_000
SALTS = 64
#: Bits of a level for each digest that is still without a slot.
GAMMA = 2.0
_LAST = 9223372036854775807
#: Fixed value: a run of ASCII white space.
WHITE_RUN = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the text with white-space runs as one space."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE_RUN, " ")
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"))


# ------------------------------------------------------------------ one shard

def _level_hash(words: np.ndarray, level: int) -> np.ndarray:
    """A hash of the four digest words that differs from level to level."""
    k = np.uint64(2 * level + 1)
    x = words[:, 0] * k + words[:, 1] * np.uint64(0x9E3779B97F4A7C15)
    x ^= (words[:, 2] + np.uint64(level)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= words[:, 3] >> np.uint64(1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _words(digest_bytes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digest_bytes).view(">u8").astype(np.uint64).reshape(-1, 4)


def as_matrix(digest_column) -> np.ndarray:
    joined = b"".join(bytes(d) for d in digest_column)
    return np.frombuffer(joined, np.uint8).reshape(-1, 32)


def build_levels(matrix: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and their bits, for distinct digests."""
    left = _words(matrix)
    sizes, bits, level = [], [], 0
    while len(left):
        m = max(64, int(GAMMA * len(left)))
        at = (_level_hash(left, level) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        bits.append(alone)
        left = left[~alone[at]]
        level += 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots_of(matrix: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest, or -1 where no level has its bit."""
    words, base = _words(matrix), 0
    rank = np.cumsum(bits) - 1
    slot = np.full(len(words), -1, np.int64)
    for level, m in enumerate(sizes):
        open_ = np.flatnonzero(slot < 0)
        if not len(open_):
            break
        at = base + (_level_hash(words[open_], level) % np.uint64(m)).astype(np.int64)
        hit = bits[at]
        slot[open_[hit]] = rank[at[hit]]
        base += m
    return slot


_INDEX = "shard long, sizes array<long>, bits binary, n long, slots binary, winners binary, counts binary"


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    matrix = as_matrix(pdf["digest"])
    sizes, bits = build_levels(matrix)
    slot = slots_of(matrix, sizes, bits)
    slots = np.empty_like(matrix)
    winners, counts = np.empty(len(slot), "<i8"), np.empty(len(slot), "<i8")
    slots[slot] = matrix
    winners[slot] = pdf["winner"].to_numpy()
    counts[slot] = pdf["n"].to_numpy()
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()],
                         "n": [int(bits.sum())], "slots": [slots.tobytes()], "winners": [winners.tobytes()],
                         "counts": [counts.tobytes()]})


def _look_up(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """Winner and row count of each batch digest in the shard's history."""
    winner = np.full(len(batch), -1, np.int64)
    count = np.zeros(len(batch), np.int64)
    if len(index) and len(batch):
        row = index.iloc[0]
        sizes = [int(x) for x in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        matrix = as_matrix(batch["digest"])
        slot = slots_of(matrix, sizes, bits)
        seen = np.flatnonzero(slot >= 0)
        held = np.frombuffer(row["slots"], np.uint8).reshape(-1, 32)[slot[seen]]
        same = seen[(held == matrix[seen]).all(axis=1)]
        winner[same] = np.frombuffer(row["winners"], "<i8")[slot[same]]
        count[same] = np.frombuffer(row["counts"], "<i8")[slot[same]]
    return pd.DataFrame({"digest": batch["digest"], "own_winner": batch["winner"], "own_n": batch["n"],
                         "salts": batch["salts"], "old_winner": winner, "old_n": count})


# ---------------------------------------------------------------- the operator

def _shard(n: int):
    """Shard of a digest by its leading 8 hex digits."""
    return (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % n).alias("shard")


def _groups(rows: DataFrame) -> DataFrame:
    """One row per digest: winner, row count, and the salts its rows have."""
    part = rows.groupBy("digest", "salt").agg(F.min("key").alias("winner"), F.count(F.lit(1)).alias("n"))
    return part.groupBy("digest").agg(F.min("winner").alias("winner"), F.sum("n").alias("n"),
                                      F.collect_list("salt").alias("salts"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the minimal perfect hash over the history's groups
    (columns digest, winner, n)."""
    return (history.select(_shard(shards), "digest", "winner", "n")
            .groupBy("shard").applyInPandas(_build_shard, _INDEX))


def dedup(docs: DataFrame, is_history=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest, keep_id, group_size, kept.

    ``is_history`` (a condition over column ``id``) names the rows of the known
    generation; by default the rows whose id lies below the middle of the id
    range, i.e. the older half of a table whose ids grow with time.
    """
    rows = stage(digests(docs, id_col, text_col)
                 .withColumn("key", F.coalesce("id", F.lit(_LAST)))
                 .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), "digests")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    if is_history is None:
        middle = 0 if low is None else (low + high) // 2
        is_history = F.col("id") < F.lit(middle)
    is_history = F.coalesce(is_history, F.lit(False))
    shards = 1 + n // SHARD_ROWS
    old = stage(_groups(rows.where(is_history)), "history")
    new = _groups(rows.where(~is_history)).select(_shard(shards), "*")
    index = build_index(old, shards)
    found = (index.groupBy("shard").cogroup(new.groupBy("shard"))
             .applyInPandas(_look_up, "digest binary, own_winner long, own_n long, salts array<int>, "
                                      "old_winner long, old_n long"))
    looked = stage(found, "looked_up")
    member = F.col("old_n") > 0
    batch_groups = looked.select(
        "digest", "salts",
        F.when(member, F.least("own_winner", "old_winner")).otherwise(F.col("own_winner")).alias("winner"),
        (F.col("own_n") + F.col("old_n")).alias("n"))
    # history groups learn of the batch rows that repeated them
    repeats = looked.where(member).select("digest", F.col("own_winner").alias("w2"), F.col("own_n").alias("n2"))
    old_groups = (old.join(repeats, "digest", "left")
                  .select("digest", "salts", F.least("winner", F.coalesce("w2", "winner")).alias("winner"),
                          (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")))

    def back(part, groups):
        return part.join(groups.select("digest", "winner", "n", F.explode("salts").alias("salt")), ["digest", "salt"])

    out = back(rows.where(is_history), old_groups).unionByName(back(rows.where(~is_history), batch_groups))
    keep = F.when(F.col("winner") == F.lit(_LAST), F.lit(None).cast("long")).otherwise(F.col("winner"))
    return out.select("id", "digest", keep.alias("keep_id"), F.col("n").alias("group_size"),
                      (F.col("key") == F.col("winner")).alias("kept"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: a row of the
    smallest id, of several the one with the least hash over its columns."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_id, own_text = (f"c{names.index(c)}" for c in (id_col, text_col))
    verdict = dedup(docs, None, id_col, text_col)
    entries = verdict.groupBy(F.col("id").alias("drop_id"), F.col("digest").alias("drop_digest")).agg(
        F.first("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    entries = stage(entries, "entries")
    norm = F.regexp_replace(F.coalesce(F.col(own_text), F.lit("")), WHITE_RUN, " ")
    digest = F.unhex(F.sha2(norm.cast("binary"), 256))
    key = lambda t: t.select("drop_id", "drop_digest")
    return survivors(flat, F.col(own_id).cast("long"), digest, key(entries.where("NOT kept")),
                     key(entries.where("kept AND rows > 1"))).toDF(*names)
