"""Merkle manifest of a dataset, proved by octopus multiproofs.

Rows are leaves of one binary tree for each group (``tree``, the language);
the roots of the groups are the leaves of a top tree.  A node without a
partner is hashed alone.  Digests are SHA-256, hashed as lowercase hex text.

Building: leaves are range partitioned by (tree, id, digest), numbered in
their partition, and moved to their position by one small table of offsets.
Runs of ``2 ** BLOCK`` consecutive nodes are reduced to one node in one task,
and the runs' results form the next tier, so a tree of any size takes about
``log(leaves) / BLOCK`` jobs and no task holds more than a run.  All nodes are
kept, as (tree, level, idx, digest).

Proving: a leaf partition holds the asked leaves of one run.  It first computes
the coordinates that it cannot derive from its own leaves, at every level
the siblings of known nodes that are not known themselves: the least union for
all of its leaves.  These are fetched by one join with the nodes.  Then the
interior nodes that the leaves share are derived once, and each leaf's own
proof is read off.  Nodes of high levels are asked for by many partitions;
they are copied over salts, as many as their level has askers (``SALTS`` at
most), so no key of the join is hot.

Cases: nulls are hashed as ``-``, with a length before every other value; null
ids sort first; null groups form a tree of their own, before the others; rows
that repeat an id are ordered by digest, and equal rows are interchangeable
(they are spread by a row number, so many of them are no hot range); empty
texts are values like others; very long texts are hashed in the JVM and never
shuffled; an empty table has no root and gives an empty result; other columns
play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.session import stage

#: Levels that one task reduces: runs of 1,024 nodes.
BLOCK = 10
#: Copies of a node that many leaf partitions ask for.
SALTS = 1_024
#: Leaves of one range partition.
RANGE_ROWS = 500_000
#: The top tree's name, and the prefix of the others' (groups without a name come first).
TOP, UNNAMED, NAMED = "2", "0", "1"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` or its UTF-8 length, ``:``, value."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[told(f.cast("string")) for f in fields]).cast("binary"), 256))


def tree_name(group: Column) -> Column:
    return F.coalesce(F.concat(F.lit(NAMED), group.cast("string")), F.lit(UNNAMED))


def _parent(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def missing(known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The least set of (level, idx) needed beside the leaves ``known`` to
    derive the root of a tree of ``n`` leaves and the proofs of all of them."""
    out, cur, level = [], np.unique(known), 0
    while n > 1:
        beside = cur ^ 1
        need = np.setdiff1d(beside[beside < n], cur, assume_unique=True)
        out += [(level, int(i)) for i in need]
        cur, n, level = np.unique(cur >> 1), (n + 1) // 2, level + 1
    return out


def derive(known: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[dict[int, str]]:
    """All nodes, by level, that follow from leaves and fetched nodes."""
    by_level: list[dict[int, str]] = [{} for _ in range(height(n))]
    for (level, i), digest in fetched.items():
        by_level[level][i] = digest
    levels, cur, level = [], dict(known), 0
    while n > 1:
        cur.update(by_level[level])
        levels.append(cur)
        nxt = {}
        for i in {i >> 1 for i in cur}:
            pair = [cur.get(2 * i), cur.get(2 * i + 1) if 2 * i + 1 < n else ""]
            if None not in pair:
                nxt[i] = _parent(*pair)
        cur, n, level = nxt, (n + 1) // 2, level + 1
    return [*levels, cur]


def siblings(levels: list[dict[int, str]], pos: int, start: int = 0) -> list[str]:
    """The digests beside the path from ``pos``, an index at level ``start``
    (empty where a node is alone)."""
    out = []
    for level in range(start, len(levels) - 1):
        out.append(levels[level].get(pos ^ 1, ""))
        pos >>= 1
    return out


def fold(digest: str, pos: int, beside: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for other in beside:
        digest = _parent(other, digest) if pos & 1 else _parent(digest, other)
        pos >>= 1
    return digest


# ------------------------------------------------------------------ building

def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (with ``tree``) and ``pos``, its place in its tree by ``order``."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + df.count() // RANGE_ROWS)
    cols = [f"{c} {t}" for c, t in df.dtypes]

    def number(batches):
        part, tree, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            names = b.column(b.schema.get_field_index("tree")).to_numpy(zero_copy_only=False)
            if not len(names):
                continue
            # trees are runs of the sorted rows, and may go on from the last batch
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            seq = np.arange(len(names)) - np.repeat(first, np.diff(np.append(first, len(names))))
            if names[0] == tree:
                end = first[1] if len(first) > 1 else len(names)
                seq[:end] += seen
            tree, seen = names[-1], int(seq[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(names), part)), pa.array(seq)],
                                             [*b.schema.names, "part", "seq"])

    ranged = stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        number, ", ".join([*cols, "part long", "seq long"])), "numbered")
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("off"))
    return (ranged.join(offsets, ["tree", "part"]).withColumn("pos", F.col("off") + F.col("seq")).drop("part", "seq", "off"))


def _reduce_run(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes above a run: up to the run's one node, or the tree's root."""
    pdf = pdf.sort_values("idx")
    tree, level, m = pdf["tree"].iloc[0], int(pdf["level"].iloc[0]), int(pdf["m"].iloc[0])
    idx, cur = int(pdf["idx"].iloc[0]), [bytes(d).hex() for d in pdf["digest"]]
    rows = []
    for up in range(1, min(BLOCK, height(m)) + 1):
        cur, idx = [_parent(*cur[k:k + 2]) for k in range(0, len(cur), 2)], idx >> 1
        rows += [(tree, level + up, idx + k, bytes.fromhex(d)) for k, d in enumerate(cur)]
    return pd.DataFrame(rows, columns=["tree", "level", "idx", "digest"])


_NODES = "tree string, level int, idx long, digest binary"


def _nodes(leaves: DataFrame, sizes: DataFrame) -> DataFrame:
    """All nodes of the trees with these leaves (tree, pos, digest)."""
    own = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest")
    out, tier, level = own, own, 0
    while not sizes.where(F.ceil(F.col("n") / F.lit(float(1 << level))) > 1).isEmpty():
        width = F.expr(f"(n + {(1 << level) - 1}) div {1 << level}")
        runs = tier.join(sizes.select("tree", width.alias("m")).where("m > 1"), "tree").withColumn(
            "run", F.shiftright("idx", BLOCK))
        made = stage(runs.groupBy("tree", "run").applyInPandas(_reduce_run, _NODES), "nodes")
        out, level = out.unionByName(made), level + BLOCK
        tier = made.where(F.col("level") == level)
    return out


@dataclass
class Manifest:
    """``rows``: leaves with ``tree``, ``pos``; ``nodes``: all nodes; ``trees``:
    (tree, n, subroot, top_pos, n_top); ``root``: hex text, or None."""
    rows: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: ``tree``, ``doc_id``, ``digest`` and columns
    to be carried along."""
    flat = stage(leaves.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    rows = stage(_numbered(flat, ["tree", "doc_id", "digest", "salt"]).drop("salt"), "rows")
    sizes = stage(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "sizes")
    nodes = _nodes(rows, sizes)
    # the level of a tree's last node: the bits of n - 1
    top = sizes.withColumn("level", F.length(F.bin(F.col("n") - 1)) * (F.col("n") > 1).cast("int"))
    subroots = stage(_numbered(nodes.where("idx = 0").join(top, ["tree", "level"]).select(
        F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "n", "digest"), ["tree", "name"]), "subroots")
    n_top = subroots.count()
    above = _nodes(subroots, subroots.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    last = above.where((F.col("idx") == 0) & (F.col("level") == height(n_top))).select("digest").first()
    trees = subroots.select(F.col("name").alias("tree"), "n", F.lower(F.hex("digest")).alias("subroot"),
                            F.col("pos").alias("top_pos"), F.lit(n_top).cast("long").alias("n_top"))
    return Manifest(rows, nodes.unionByName(above), trees, bytes(last[0]).hex() if last else None)


# ------------------------------------------------------------------- proving

def _requests(pdf: pd.DataFrame) -> pd.DataFrame:
    """Coordinates that a leaf partition needs beside its leaves."""
    tree, run = pdf["tree"].iloc[0], pdf["run"].iloc[0]
    own = missing(pdf["pos"].to_numpy(), int(pdf["n"].iloc[0]))
    above = missing(np.array([int(pdf["top_pos"].iloc[0])]), int(pdf["n_top"].iloc[0]))
    rows = [(tree, run, tree, *c) for c in own] + [(tree, run, TOP, *c) for c in above]
    return pd.DataFrame(rows, columns=["tree", "run", "of", "level", "idx"])


def _salts(of: str) -> Column:
    """Copies of a node: as many as its level has runs below it."""
    return F.expr(f"CASE WHEN {of} = '{TOP}' THEN {SALTS}L "
                  f"ELSE least(shiftleft(1L, least(greatest(level - {BLOCK}, 0), 30)), {SALTS}L) END")


def _expand(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the leaves of one partition from what it fetched."""
    if rows.empty:
        return pd.DataFrame(columns=_PROVED)
    own, top = {}, {}
    for of, level, i, digest in zip(nodes["of"], nodes["level"], nodes["idx"], nodes["digest"]):
        (top if of == TOP else own)[int(level), int(i)] = bytes(digest).hex()
    pos = rows["pos"].to_numpy().tolist()
    leaf = [bytes(d).hex() for d in rows["digest"]]
    claimed = [bytes(d).hex() for d in rows["claimed"]]
    n, t, n_top = (int(rows[c].iloc[0]) for c in ("n", "top_pos", "n_top"))
    levels = derive(dict(zip(pos, leaf)), own, n)
    above = derive({t: levels[-1][0]}, top, n_top)
    rest = siblings(above, t)
    # what lies above the partition's lowest common level is shared
    low = min(BLOCK, len(levels) - 1)
    shared = [siblings(levels, p >> low, low) for p in pos[:1]][0] if len({p >> low for p in pos}) == 1 else None
    proofs, folded = [], []
    for p, own_digest, said in zip(pos, leaf, claimed):
        beside = siblings(levels[:low + 1], p) + (shared if shared is not None else siblings(levels, p >> low, low))
        proofs.append(hashlib.sha256("".join(beside + rest).encode()).hexdigest())
        folded.append(above[-1][0] if said == own_digest else fold(fold(said, p, beside), t, rest))
    return pd.DataFrame({"tree": rows["tree"], "doc_id": rows["doc_id"], "leaf": leaf, "proof": proofs, "folded_root": folded})


_PROVED = ["tree", "doc_id", "leaf", "proof", "folded_root"]


def prove(m: Manifest, asked: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of the
    ``asked`` rows of the manifest, whose ``claimed`` digest is tested.
    ``proof`` is the digest of the siblings' hex texts from leaf to root."""
    rows = (asked.select("tree", "pos", "doc_id", "digest", "claimed").join(m.trees, "tree")
            .withColumn("run", F.shiftright("pos", BLOCK)))
    keys = rows.select("tree", "run", "pos", "n", "top_pos", "n_top").groupBy("tree", "run")
    wanted = keys.applyInPandas(_requests, "tree string, run long, of string, level int, idx long")
    wanted = stage(wanted.withColumn("salt", F.pmod(F.xxhash64("tree", "run"), _salts("of"))), "wanted")
    least = wanted.where(F.col("of") != TOP).agg(F.min("level")).first()[0]
    held = m.nodes.where((F.col("level") >= (height(1 << 62) if least is None else least)) | (F.col("tree") == TOP))
    held = (held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), _salts("tree") - 1)))
            .withColumnRenamed("tree", "of"))
    fetched = stage(wanted.join(held, ["of", "level", "idx", "salt"]).select("tree", "run", "of", "level", "idx", "digest"),
                    "fetched")
    # ids travel as text: a null would turn a column of integers into floats
    leaves = rows.select("tree", "run", "pos", F.col("doc_id").cast("string"), "digest", "claimed", "n", "top_pos", "n_top")
    proved = leaves.groupBy("tree", "run").cogroup(fetched.groupBy("tree", "run")).applyInPandas(
        _expand, "tree string, doc_id string, leaf string, proof string, folded_root string")
    root = F.lit(m.root)
    return proved.join(m.trees.select("tree", "subroot"), "tree").select(
        F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, claimed) of documents; ``claimed`` is the digest
    with one character more counted in the rows chosen for a tamper test."""
    c = F.col
    told = lambda n_chars: leaf_digest(c("doc_id").cast("long"), c("source"), c("lang"), n_chars, c("text"))
    chosen = F.crc32(c("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0
    flat = docs.select(c("doc_id").cast("long").alias("doc_id"), "source", "lang", c("n_chars").cast("long").alias("n_chars"), "text")
    return flat.select(tree_name(c("lang")).alias("tree"), "doc_id", told(c("n_chars")).alias("digest"),
                       F.when(chosen & c("n_chars").isNotNull(), told(c("n_chars") + 1)).alias("changed")).select(
        "tree", "doc_id", "digest", F.coalesce("changed", "digest").alias("claimed"))
