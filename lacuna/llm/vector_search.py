"""Approximate nearest neighbours by multi-index hashing.

Equal vectors form one class with its smallest ids.  A rotation learned on a
bounded sample (iterative quantisation of the centred unit vectors) gives each
class a code of 64 bits, split into ``PARTS`` substrings that are indexed one
by one.  A code within Hamming radius r of a query agrees with it in at least
one substring up to r // PARTS bits, so probing every substring bucket at that
distance retrieves every code within the radius.  What passes the full Hamming
test, and nothing else, is multiplied and ranked by the cosine of the original
vectors in double precision.

The radius is calibrated on the sample: the ``COVER`` quantile of the Hamming
distances between sample vectors and their true neighbours there (in the whole
table true neighbours are nearer still).  Queries that find fewer than k
others are searched again with the whole radius.

Scale: the index is dealt by (substring, leading bits of its value), about
``SHARD_ROWS`` classes a shard; fuller shards are split, and queries go to the
shards that hold buckets they probe, in blocks of ``QUERY_BLOCK``.  Each cell
sends only its best rows for each query.  Copies of one vector, however many,
are reduced to their k + 1 smallest ids before any shuffle of vectors, and
equal queries are searched once.

Cases: vectors that are null, zero, hold null or non-finite components, or are
not of the most frequent length take no part; ties go to the smaller id; rows
that repeat the query's own id are not its neighbours; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.session import stage, unstage

BITS, PARTS = 64, 4
PART_BITS = BITS // PARTS
SAMPLE_ROWS, SAMPLE_QUERIES, COVER = 4_096, 512, 0.985
SHARD_ROWS, QUERY_BLOCK = 20_000, 4_096
#: Scores that differ by less are equal: ties go to the smaller id.
TIE, TIE_PLACES = 1e-11, 12


def usable(vec):
    """Whether a vector takes part: finite, without nulls, not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0.0), F.lit(False))


# ------------------------------------------------------------------- the codes

class Rotation:
    """Centre and projection whose signs are the code."""

    def __init__(self, sample: np.ndarray, rounds: int = 30):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
        d = sample.shape[1]
        self.centre = unit.mean(axis=0) if len(unit) else np.zeros(d)
        rng = np.random.default_rng(7)
        x = unit - self.centre
        if d >= BITS and len(x) > 1:
            _, axes = np.linalg.eigh(x.T @ x)
            lift = axes[:, ::-1][:, :BITS]
        else:
            lift = np.hstack([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-BITS // d))])[:, :BITS]
        y = x @ lift
        turn = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
        for _ in range(rounds if len(x) > 1 else 0):
            u, _, vt = np.linalg.svd(np.sign(y @ turn).T @ y)
            turn = (u @ vt).T
        self.projection = lift @ turn

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bits = (unit - self.centre) @ self.projection > 0
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def radius_for(sample: np.ndarray, rotation: Rotation, k: int) -> int:
    """The Hamming radius that covers the sample's own true neighbours."""
    if len(sample) <= k + 1:
        return BITS
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    codes, q = rotation.codes(sample), min(SAMPLE_QUERIES, len(sample))
    near = unit[:q] @ unit.T
    near[np.arange(q), np.arange(q)] = -np.inf
    top = np.argpartition(-near, k, axis=1)[:, :k]
    return int(np.quantile(np.bitwise_count(codes[:q, None] ^ codes[top]), COVER, method="higher"))


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _coder(rotation: Rotation, dim: int):
    def kernel(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([hashlib.md5(r.tobytes()).digest() for r in x], pa.binary()),
                pa.array(rotation.codes(x).view(np.int64)), pa.array([r.tobytes() for r in x], pa.binary())],
                ["id", "same", "code", "vec"])
    return kernel


# ---------------------------------------------------------------- one shard

def _search(dim: int, radius: int, k: int):
    part_radius = radius // PARTS
    mask = np.uint64((1 << PART_BITS) - 1)

    def part(codes, j):
        return (codes >> np.uint64(PART_BITS * j)) & mask

    def members(first, count):
        """The places first, first + 1, ... of several runs, one after the other."""
        ends = np.cumsum(count)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)

    def kernel(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "ids": [], "score": []}
        if len(index) and len(queries):
            j = int(index["part"].iloc[0])
            # classes in the order of their bucket, so that a bucket is a run
            index = index.iloc[np.argsort(part(index["code"].to_numpy().view(np.uint64), j), kind="stable")]
            x, y = _matrix(index["vec"], dim), _matrix(queries["vec"], dim)
            xn, yn = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            xu = x / xn[:, None]
            xc, yc = index["code"].to_numpy().view(np.uint64), queries["code"].to_numpy().view(np.uint64)
            buckets, first, count = np.unique(part(xc, j), return_index=True, return_counts=True)
            ids, names = index["ids"].tolist(), queries["id"].tolist()
            for q, code in enumerate(yc):
                probed = np.flatnonzero(np.bitwise_count(buckets ^ part(code, j)) <= part_radius)
                hit = members(first[probed], count[probed])
                hit = hit[np.bitwise_count(xc[hit] ^ code) <= radius]
                for i in range(j):   # retrieved by an earlier substring already
                    hit = hit[np.bitwise_count(part(xc[hit], i) ^ part(code, i)) > part_radius]
                if not len(hit):
                    continue
                near = xu[hit] @ (y[q] / yn[q])
                # every class within rounding of the k-th best: the exact score and the id settle ties
                least = np.partition(near, len(near) - k)[len(near) - k] if len(near) > k else -np.inf
                best = hit[near >= least - TIE]
                scores = np.einsum("ij,j->i", x[best], y[q]) / (xn[best] * yn[q])
                ranked = sorted(zip(best.tolist(), scores.tolist()), key=lambda t: (-round(t[1], TIE_PLACES), ids[t[0]][0]))
                for c, score in ranked[:k]:
                    out["query"].append(names[q])
                    out["ids"].append(ids[c])
                    out["score"].append(score)
        return pd.DataFrame({"query": pd.Series(out["query"], dtype="int64"), "ids": pd.Series(out["ids"], dtype=object),
                             "score": pd.Series(out["score"], dtype="float64")})

    return kernel


def _probe(classes: DataFrame, queries: DataFrame, shards: DataFrame, dim: int, radius: int, k: int, lead: int,
           blocks: int) -> DataFrame:
    """(query, found): the k best (score, id) of the classes in the radius."""
    parts = F.explode(F.array(*[F.struct(F.lit(j).alias("part"), F.expr(
        f"(shiftrightunsigned(code, {PART_BITS * j}) & {(1 << PART_BITS) - 1})").alias("value")) for j in range(PARTS)]))
    lead_of = F.shiftright("p.value", PART_BITS - lead).alias("lead")
    keys = ["part", "lead", "split", "block"]
    index = (classes.select("*", parts.alias("p")).select("ids", "code", "vec", "p.part", lead_of)
             .join(F.broadcast(shards), ["part", "lead"])
             .select("ids", "code", "vec", "part", "lead",
                     F.pmod(F.xxhash64("code", F.col("ids")[0]), F.col("splits")).alias("split"),
                     F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block")))
    near = F.bit_count(F.col("q.lead").bitwiseXOR(F.col("s.lead"))) <= radius // PARTS
    asked = (queries.select("id", "code", "vec", parts.alias("p")).select("id", "code", "vec", "p.part", lead_of)
             .alias("q").join(F.broadcast(shards).alias("s"), (F.col("q.part") == F.col("s.part")) & near)
             .select("id", "code", "vec", F.col("q.part").alias("part"), F.col("s.lead").alias("lead"),
                     F.explode(F.expr("sequence(0L, splits - 1)")).alias("split"),
                     F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")).alias("block")))
    best = (index.groupBy(*keys).cogroup(asked.groupBy(*keys))
            .applyInPandas(_search(dim, radius, k), "query long, ids array<long>, score double"))
    each = best.select("query", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", TIE_PLACES)), "id")
    return (each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query")
            .agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found")))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each row that
    meets ``is_query`` (a condition over column ``id``)."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not most:
        return spark.createDataFrame([], schema)
    dim, total = most[0]["d"], most[0]["count"]
    rows = rows.where(F.size("vec") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()["vec"]
    sample = np.unique(np.array(sample.tolist(), np.float64).reshape(-1, dim), axis=0)
    sample = np.random.default_rng(3).permutation(sample)
    rotation = Rotation(sample)
    radius = radius_for(sample, rotation, k)
    coded = stage(rows.mapInArrow(_coder(rotation, dim), "id long, same binary, code long, vec binary"), "codes")
    # the k + 1 smallest ids of equal vectors are all that can be reported
    first = Window.partitionBy("same").orderBy("id")
    classes = stage(coded.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("same")
                    .agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("code").alias("code"),
                         F.first("vec").alias("vec")), "classes")
    asked = coded.where(is_query).select("id", "same")
    queries = asked.select("same").distinct().join(classes, "same").select(F.col("ids")[0].alias("id"), "same", "code", "vec")
    queries = stage(queries, "queries")
    n_classes, n_queries = classes.count(), queries.count()
    lead = min(PART_BITS, max(0, int(np.ceil(np.log2(max(1.0, n_classes / SHARD_ROWS))))))
    blocks = 1 + n_queries // QUERY_BLOCK
    # one row per shard, at most PARTS * 2 ** lead: a proven bound
    at = F.explode(F.array(*[F.struct(F.lit(j).alias("part"), F.expr(
        f"shiftright((shiftrightunsigned(code, {PART_BITS * j}) & {(1 << PART_BITS) - 1}), {PART_BITS - lead})").alias("lead"))
        for j in range(PARTS)]))
    shards = stage(classes.select(at.alias("p")).groupBy("p.part", "p.lead")
                   .agg(F.expr(f"1 + count(1) div {2 * SHARD_ROWS}").alias("splits")), "shards")
    found = stage(_probe(classes, queries, shards, dim, radius, k + 1, lead, blocks), "found")
    enough = min(k + 1, total)
    short = stage(queries.join(found.where(F.size("found") >= enough), F.col("id") == F.col("query"), "left_anti"), "short")
    if radius < BITS and not short.isEmpty():
        again = _probe(classes, short, shards, dim, BITS, k + 1, lead, blocks)
        found = found.join(short, F.col("query") == F.col("id"), "left_anti").unionByName(again)
    best = queries.select("id", "same").join(found, F.col("id") == F.col("query")).select("same", "found")
    # one row of the query's own id is itself; what is left are its neighbours
    others = F.filter("found", lambda f: f["id"] != F.col("id"))
    out = (asked.join(best, "same")
           .select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("pos", "f"))
           .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), "f.score"))
    unstage(short)
    return out
