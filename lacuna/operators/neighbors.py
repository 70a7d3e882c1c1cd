"""Exact k-nearest neighbours between a query table and a donor table
(M-04 recommender, I-05 imputer), pruned by boxes.

Rows are dealt to tiles by missing pattern and by k-d splits that a bounded
keyed sample fixes (``SAMPLE_ROWS``); any split is correct, as the boxes that
prune are taken over all rows.  Two rows of known patterns share known
coordinates, so the squared distance of two boxes over these, scaled alike, is
a lower bound for every pair in them; it is added up in the order of the
features, and so never above a distance by rounding.

1. Each query tile meets its home, the donor tile whose boxes are closest.
   Inside, both sides are cut into cells of ``CELL_ROWS`` by medians, donors
   anew for each pattern of the queries over the columns these know; the cells
   of donors are visited by rising bound until the bound passes the k-th
   distance found.  Of equal points only the k smallest ids are met.
2. The k-th distances then bound whole tiles: a query tile visits the donor
   tiles whose bound is not above its largest k-th distance, and no others,
   each query with its own limit.  Up to ``PACK_TILES`` query tiles visit a donor
   tile together: it is moved and cut into cells once for all of them.

The k best of a query are the k smallest of what its tiles gave, ties by donor
id, so the result depends on no tiling.  What reaches the driver are the sample
and one box for each leaf of its splits; rows of patterns that the sample has
not seen go to shared leaves without bounds.  A leaf larger than a tile (a hot
value) is split by a keyed draw.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.draws import uniform
from lacuna.session import stage, unstage

#: Rows of a query tile and a donor tile, of a cell, of the sample of splits.
QUERY_ROWS, DONOR_ROWS, CELL_ROWS, SAMPLE_ROWS = 8_192, 131_072, 64, 65_536
#: Query tiles that visit a donor tile together at most, and the neighbours that they may find in all.
PACK_TILES, PACK_FOUND = 16, 1 << 21
#: Cells of donors that a cell of queries meets at once; pairs of rows at once.
STEP_CELLS, PAIRS = 256, 1 << 16
_MIXED = -1


def patterns(x: np.ndarray) -> np.ndarray:
    """Known columns of each row as bits."""
    return (~np.isnan(x)).astype(np.int64) @ (1 << np.arange(x.shape[1], dtype=np.int64))


def _widest(x: np.ndarray) -> tuple[int, float]:
    spread = np.where(np.isnan(x[0]), -1.0, x.max(axis=0) - x.min(axis=0))
    return int(spread.argmax()), float(spread.max())


@dataclass
class Cells:
    """Rows in the order of their cells, and each cell's box and pattern."""
    order: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pattern: np.ndarray


def cells(x: np.ndarray, rows: int) -> Cells:
    """Rows of one pattern cut beside the median of the widest column until a
    cell holds ``rows`` or has one point."""
    kind = patterns(x)
    order = np.argsort(kind, kind="stable")
    ends = [0, *(np.flatnonzero(np.diff(kind[order])) + 1).tolist(), len(x)]
    # one row a column, and a node's points beside each other
    points, open_, start = np.ascontiguousarray(x[order].T), list(zip(ends[:-1], ends[1:])) if len(x) else [], []
    while open_:
        a, b = open_.pop()
        if b - a > rows:
            own = points[:, a:b]
            spread = np.where(np.isnan(own[:, 0]), -1.0, own.max(axis=1) - own.min(axis=1)) if len(own) else np.zeros(1)
            if spread.max() > 0:
                # equal values stay together, so that equal points share a cell
                value, half = own[spread.argmax()], (b - a) // 2
                middle = np.partition(value, half)[half]
                left, most = value < middle, value <= middle
                less, some = int(left.sum()), int(most.sum())
                if not less or (some < b - a and some - half < half - less):
                    left, less = most, some
                place = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
                points[:, a:b], order[a:b] = own[:, place], order[a:b][place]
                open_ += [(a + less, b), (a, a + less)]
                continue
        start.append(a)
    at = np.array(sorted(start), np.int64)
    low, high = (f.reduceat(points, at, axis=1).T if len(at) else np.zeros((0, x.shape[1])) for f in (np.minimum, np.maximum))
    return Cells(order, np.append(at, len(x)), low, high, kind[order[at]] if len(at) else np.zeros(0, np.int64))


def box_distance(low, high, lows, highs, nan_euclidean: bool) -> np.ndarray:
    """Squared distance between one box and others: over known coordinates of
    both, added in their order; infinite where none is shared (nan-Euclidean)."""
    p = len(low)
    acc, shared = np.zeros(len(lows)), np.zeros(len(lows))
    for j in range(p):
        ok = ~np.isnan(lows[:, j]) & ~np.isnan(low[j])
        gap = np.maximum(np.maximum(lows[:, j] - high[j], low[j] - highs[:, j]), 0.0)
        acc += np.where(ok, gap * gap, 0.0)
        shared += ok
    if not nan_euclidean:
        return acc
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, (float(p) / shared) * acc, np.inf)


def distances(x: np.ndarray, y: np.ndarray, nan_euclidean: bool) -> np.ndarray:
    """Squared distances, coordinates added in their order; infinite where no
    coordinate is shared (nan-Euclidean)."""
    p = x.shape[1]
    acc, shared = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for j in range(p):
        diff = x[:, j, None] - y[None, :, j]
        diff *= diff
        ok = ~np.isnan(diff)
        np.add(acc, diff, out=acc, where=ok)
        shared += ok
    if not nan_euclidean:
        return acc
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, (float(p) / shared) * acc, np.inf)


class _Best:
    """The k least (distance, id) of each query, with values."""

    def __init__(self, limit: np.ndarray, k: int):
        n = len(limit)
        self.k, self.limit = k, limit
        self.d2, self.id, self.value = np.full((n, k), np.inf), np.zeros((n, k), np.int64), np.zeros((n, k))

    def edge(self) -> np.ndarray:
        return np.minimum(self.d2[:, -1], self.limit)

    def last(self) -> np.ndarray:
        """The id below which a donor at the edge is still nearer."""
        return np.where(self.d2[:, -1] <= self.limit, self.id[:, -1], np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, d2: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        """Pairs of a query's place, a distance, a donor id and its value."""
        edge, last = self.edge(), self.last()
        near = np.flatnonzero((d2 <= edge[row]) & (d2 < np.inf))
        near = near[(d2[near] < edge[row[near]]) | (ids[near] < last[row[near]])]
        if not len(near):
            return
        old, place = np.nonzero(self.d2 < np.inf)
        rows = np.concatenate([old, row[near]])
        far = np.concatenate([self.d2[old, place], d2[near]])
        who = np.concatenate([self.id[old, place], ids[near]])
        what = np.concatenate([self.value[old, place], values[near]])
        order = np.lexsort((who, far, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < self.k
        rows, rank, order = rows[keep], rank[keep], order[keep]
        touched = np.unique(rows)
        self.d2[touched] = np.inf
        self.d2[rows, rank], self.id[rows, rank], self.value[rows, rank] = far[order], who[order], what[order]


class _Donors:
    """Donors as queries of one pattern see them: cut into cells over the
    columns that these queries know, so that a box is no wider for a column
    that is not compared.  Of equal points, which are equally far from every
    query, the k smallest ids for each column asked stay."""

    def __init__(self, y: np.ndarray, ids: np.ndarray, kind: int, k: int, asked: list, nan_euclidean: bool):
        p = y.shape[1]
        self.columns = [j for j in range(p) if kind >> j & 1]
        self.p, self.nan_euclidean = p, nan_euclidean
        seen = y[:, self.columns]
        cut = cells(seen, CELL_ROWS)
        parts = [cut.order[a:b] if b - a <= CELL_ROWS else self._first(cut.order[a:b], y, ids, k, asked)
                 for a, b in zip(cut.start[:-1], cut.start[1:])]
        self.size = np.array([len(r) for r in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        order = np.concatenate([np.zeros(0, np.int64), *parts])
        self.point = np.ascontiguousarray(seen[order].T)
        self.id = ids[order]
        self.known = {j: ~np.isnan(y[order, j]) if j >= 0 else np.ones(len(order), bool) for j in asked}
        self.value = {j: y[order, j] if j >= 0 else np.zeros(len(order)) for j in asked}
        self.low, self.high = cut.low, cut.high
        held = np.zeros(len(order), bool)
        for j in asked:
            held |= self.known[j]
        self.able = np.add.reduceat(held, self.start[:-1], dtype=np.int64) > 0 if len(order) else np.zeros(0, bool)

    @staticmethod
    def _first(rows, y, ids, k, asked) -> np.ndarray:
        rows = rows[np.argsort(ids[rows], kind="stable")]
        stay = [rows[~np.isnan(y[rows, j])][:k] if j >= 0 else rows[:k] for j in asked]
        kept = np.unique(np.concatenate(stay))
        return kept if len(kept) else rows[:1]

    def _scaled(self, acc, shared) -> np.ndarray:
        if not self.nan_euclidean:
            return acc
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, (float(self.p) / shared) * acc, np.inf)

    def bound(self, low: np.ndarray, high: np.ndarray, at=slice(None)) -> np.ndarray:
        """Lower bounds of boxes (one a row) to cells."""
        acc, shared = np.zeros((len(low), len(self.low[at]))), np.zeros(len(self.low[at]))
        for j in range(len(self.columns)):
            lows, highs = self.low[at, j], self.high[at, j]
            ok = ~np.isnan(lows)
            gap = np.maximum(np.maximum(lows - high[:, j, None], low[:, j, None] - highs), 0.0)
            gap *= gap
            np.add(acc, gap, out=acc, where=ok & ~np.isnan(gap))
            shared += ok
        return self._scaled(acc, shared)

    def rows(self, row: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of queries and cells as pairs of queries and donors."""
        size = self.size[cell]
        end = np.cumsum(size)
        return np.repeat(row, size), np.repeat(self.start[cell] - end + size, size) + np.arange(int(size.sum()))

    def distance(self, x: np.ndarray, row: np.ndarray, donor: np.ndarray) -> np.ndarray:
        """Squared distances of pairs, coordinates added in their order;
        infinite where no coordinate is shared (nan-Euclidean)."""
        acc, shared = np.zeros(len(row)), np.zeros(len(row))
        for j, column in enumerate(self.point):
            diff = x[j][row] - column[donor]
            diff *= diff
            ok = ~np.isnan(diff)
            np.add(acc, diff, out=acc, where=ok)
            shared += ok
        return self._scaled(acc, shared)


def nearest(x, limits, y, ids, k: int, columns: list[int], nan_euclidean: bool):
    """(query place, column, rank, donor id, distance, value) of the k nearest
    donors of each query, within the query's limit for the column, and the
    number of pairs compared.  A column of -1 takes every donor; another one
    asks queries without it and donors with it.

    A cell of queries meets the cells of donors by rising bound; a query meets
    the rows of those whose bound to the query itself is within its edge, its
    closest cell first."""
    q, out, pairs = cells(x, CELL_ROWS), [], 0
    for kind in np.unique(q.pattern):
        asked = [j for j in columns if j < 0 or not kind >> j & 1]
        if not asked or not len(y):
            continue
        d = _Donors(y, ids, int(kind), k, asked, nan_euclidean)
        for c in np.flatnonzero(q.pattern == kind):
            own = q.order[q.start[c]:q.start[c + 1]]
            best = {j: _Best(limits[own, columns.index(j)], k) for j in asked}
            at = x[own][:, d.columns]
            point = np.ascontiguousarray(at.T)
            edge = lambda: np.max([b.edge() for b in best.values()], axis=0)

            def meet(row, cell, least):
                met, end = 0, np.cumsum(d.size[cell])
                for part in np.split(np.arange(len(row)), np.searchsorted(end, np.arange(PAIRS, end[-1], PAIRS))) if len(row) else []:
                    part = part[least[part] <= edge()[row[part]]]
                    who, donor = d.rows(row[part], cell[part])
                    d2, met = d.distance(point, who, donor), met + len(who)
                    far = edge()[who]
                    last = np.max([b.last() for b in best.values()], axis=0)
                    near = np.flatnonzero((d2 < far) | ((d2 == far) & (d.id[donor] <= last[who])))
                    who, donor, d2 = who[near], donor[near], d2[near]
                    for j, b in best.items():
                        known = np.flatnonzero(d.known[j][donor])
                        b.add(who[known], d2[known], d.id[donor[known]], d.value[j][donor[known]])
                return met

            bound = d.bound(q.low[c:c + 1, d.columns], q.high[c:c + 1, d.columns])[0]
            todo = np.flatnonzero(d.able & (bound < np.inf))
            todo = todo[np.argsort(bound[todo], kind="stable")]
            step = STEP_CELLS // 8
            while len(todo):
                todo = todo[:np.searchsorted(bound[todo], float(edge().max()), "right")]
                if not len(todo):
                    break
                part, todo, step = todo[:step], todo[step:], STEP_CELLS
                own_bound = d.bound(at, at, part)
                first = own_bound.argmin(axis=1)
                row = np.flatnonzero(own_bound[np.arange(len(own)), first] <= edge())
                pairs += meet(row, part[first[row]], own_bound[row, first[row]])
                own_bound[row, first[row]] = np.inf
                cell, row = np.nonzero(((own_bound <= edge()[:, None]) & (own_bound < np.inf)).T)
                pairs += meet(row, part[cell], own_bound[row, cell])
            for j in asked:
                r, rank = np.nonzero(best[j].d2 < np.inf)
                out.append((own[r], np.full(len(r), j), rank + 1, best[j].id[r, rank], best[j].d2[r, rank], best[j].value[r, rank]))
    if not out:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, float, float)], pairs
    return [np.concatenate(v) for v in zip(*out)], pairs


# ------------------------------------------------------------------- dealing

@dataclass
class Dealt:
    """``rows`` with ``_tile``; ``leaves``: (tile, last tile, pattern, low, high, rows)."""
    rows: DataFrame
    leaves: list
    tiles: int


def _splits(sample: np.ndarray, rows: int) -> dict:
    """A tree of medians for each pattern seen: (column, value, low, high)."""
    def grow(x):
        if len(x) <= rows:
            return None
        j, spread = _widest(x)
        cut = float(np.median(x[:, j]))
        left = x[:, j] < cut
        return (j, cut, grow(x[left]), grow(x[~left])) if spread > 0 and left.any() else None
    kind = patterns(sample)
    return {int(k): grow(sample[kind == k]) for k in np.unique(kind)}


def _leaf_codes(x: np.ndarray, trees: dict) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, path) of each row; paths are bits behind a leading one."""
    kind, path = patterns(x), np.ones(len(x), np.int64)

    def walk(own, tree):
        if tree is not None and len(own):
            right = x[own, tree[0]] >= tree[1]
            path[own] = path[own] * 2 + right
            walk(own[~right], tree[2]), walk(own[right], tree[3])
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        if int(k) in trees:
            walk(own, trees[int(k)])
        else:
            kind[own] = _MIXED
    return kind, path


def _deal(df: DataFrame, feats: list[str], tile_rows: int, salt: str) -> Dealt:
    """Rows (``_id`` and features) dealt to tiles of about ``tile_rows``."""
    df = stage(df, "knn")
    n, p = df.count(), len(feats)
    draw = uniform(0, salt, "_id")
    sample = df.where(draw < min(1.0, SAMPLE_ROWS / max(n, 1))).select(*feats).toPandas().to_numpy("float64", na_value=np.nan)
    trees = _splits(sample, max(1, int(len(sample) * tile_rows / (4 * max(n, 1)))))

    def kernel(batches):
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in feats])
            kind, path = _leaf_codes(x, trees)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kind), pa.array(path)], [*b.schema.names, "_kind", "_path"])

    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + ["_kind long", "_path long"])
    leafed = stage(df.mapInArrow(kernel, schema), "knn")
    unstage(df)
    found = leafed.groupBy("_kind", "_path").agg(F.count(F.lit(1)).alias("n"), *[F.min(f).alias(f"low{i}") for i, f in enumerate(feats)],
                                                 *[F.max(f).alias(f"high{i}") for i, f in enumerate(feats)])
    leaves, table, tile, held = [], [], 0, 0
    # one row for each leaf of the sample's splits
    for r in found.orderBy("_kind", "_path").collect():
        if held and held + r["n"] > tile_rows:
            tile, held = tile + 1, 0
        parts = max(1, -(-r["n"] // tile_rows))
        box = [np.array([np.nan if r[f"{s}{i}"] is None else r[f"{s}{i}"] for i in range(p)]) for s in ("low", "high")]
        table.append((r["_kind"], r["_path"], tile, parts))
        leaves.append((tile, tile + parts - 1, r["_kind"], *box, r["n"]))
        tile, held = (tile, held + r["n"]) if parts == 1 else (tile + parts, 0)
    small = df.sparkSession.createDataFrame(table, "_kind long, _path long, _first int, _parts int")
    rows = leafed.join(F.broadcast(small), ["_kind", "_path"]).withColumn(
        "_tile", F.col("_first") + F.floor(uniform(1, salt, "_id") * F.col("_parts")).cast("int"))
    return Dealt(rows.select("_id", "_tile", *feats), leaves, max((x[1] for x in leaves), default=-1) + 1)


def _tile_bounds(d: Dealt, nan_euclidean: bool):
    """For a query leaf (pattern, low, high): the lower bound of each donor tile."""
    tiles, bounded = d.tiles, [x for x in d.leaves if x[2] != _MIXED]
    lows, highs = (np.array([x[k] for x in bounded]).reshape(len(bounded), -1) for k in (3, 4))
    free = [x for x in d.leaves if x[2] == _MIXED]

    def of(kind: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.full(tiles, np.inf)
        if kind == _MIXED:
            return np.zeros(tiles)
        if bounded:
            for x, b in zip(bounded, box_distance(low, high, lows, highs, nan_euclidean)):
                out[x[0]:x[1] + 1] = np.minimum(out[x[0]:x[1] + 1], b)
        for x in free:
            out[x[0]:x[1] + 1] = 0.0
        return out
    return of


def _tile_pairs(leaves: DataFrame, d: Dealt, nan_euclidean: bool) -> DataFrame:
    """(a, b, home): for each query leaf (a, n, kind, low, high, reach) the
    donor tiles within its reach, or its closest one where it has none yet."""
    of = _tile_bounds(d, nan_euclidean)

    def kernel(frames):
        for pdf in frames:
            for a, n, kind, low, high, reach in pdf[["a", "n", "kind", "low", "high", "reach"]].itertuples(index=False):
                bound = of(kind, *(np.array(v, "float64") for v in (low, high)))
                found = [int(bound.argmin())] if np.isnan(reach) else np.flatnonzero(bound <= reach).tolist()
                yield pd.DataFrame({"a": a, "b": found, "n": n})

    return leaves.mapInPandas(kernel, "a int, b int, n long")


def _packs(pairs: DataFrame, most: int, slots: int) -> DataFrame:
    """(a, b, pack): the query tiles of a donor tile in packs of ``most`` at most,
    of fewer while there are no four packs for each slot."""
    size = max(1, min(most, pairs.count() // (4 * slots)))
    w = Window.partitionBy("b").orderBy("a")
    return pairs.select("a", "b", F.floor((F.row_number().over(w) - 1) / F.lit(size)).cast("int").alias("pack"))


def knn_candidates(queries: DataFrame, donors: DataFrame, qid: str, did: str, feats: list[str], k: int,
                   nan_euclidean: bool = False, donor_values: list[str] | None = None) -> DataFrame:
    """Long rows (qid, col, donor, d2, value, rank): for every query the k
    nearest donors by squared distance (ties by donor id).

    Plain mode: Euclidean over ``feats`` (col = '').  nan_euclidean mode
    (KNN imputation): distance over co-present coordinates scaled by
    p / present; for each column in ``donor_values`` (a subset of
    ``feats``) that a query lacks, the donors where it is present compete,
    and ``value`` carries the donor's value."""
    spark = queries.sparkSession
    given, feats = feats, [f"_f{i}" for i in range(len(feats))]
    flat = lambda df, key: df.select(F.col(key).cast("long").alias("_id"), *[
        F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(given)])
    q, d = _deal(flat(queries, qid), feats, QUERY_ROWS, "qtile"), _deal(flat(donors, did), feats, DONOR_ROWS, "dtile")
    names = donor_values or [""]
    columns = [given.index(c) if c else -1 for c in names]
    limit = [f"_l{i}" for i in range(len(names))]
    place_of = np.zeros(len(feats) + 1, np.int64)
    place_of[columns] = np.arange(len(columns))

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["_q", "_col", "_d", "_d2", "_v", "_rk"])
        x, y = (f[feats].to_numpy(dtype="float64", na_value=np.nan) for f in (left, right))
        limits = left[limit].to_numpy(dtype="float64")
        (at, col, rank, ids, d2, value), _ = nearest(x, limits, y, right["_id"].to_numpy(), k, columns, nan_euclidean)
        label = np.array(names, object)[place_of[col]]
        return pd.DataFrame({"_q": left["_id"].to_numpy()[at], "_col": label, "_d": ids, "_d2": d2, "_v": value, "_rk": rank})

    schema = "_q long, _col string, _d long, _d2 double, _v double, _rk long"

    most, slots = max(1, PACK_FOUND // (QUERY_ROWS * k * len(names))), spark.sparkContext.defaultParallelism

    def met(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """Query tiles (a) with donor tiles (b)."""
        packs = stage(_packs(pairs, min(most, PACK_TILES), slots), "knn_packs")
        ours = packs.select(F.col("a").alias("_tile"), F.col("b").alias("_other"), F.col("pack").alias("_pack"))
        theirs = packs.select(F.col("b").alias("_tile"), F.col("pack").alias("_pack")).distinct()
        left = rows.join(ours, "_tile").groupBy("_other", "_pack")
        right = d.rows.join(theirs, "_tile").groupBy("_tile", "_pack")
        return left.cogroup(right).applyInPandas(kernel, schema)

    result = lambda df: df.select(F.col("_q").alias(qid), F.col("_col").alias("col"), F.col("_d").alias("donor"),
                                  F.col("_d2").alias("d2"), F.col("_v").alias("value"), F.col("_rk").cast("int").alias("rank"))
    if not q.tiles or not d.tiles:
        return result(spark.createDataFrame([], schema))
    # one row for each leaf of the sample's splits and each tile it fills
    leaves = spark.createDataFrame([(t, x[5], x[2], x[3].tolist(), x[4].tolist()) for x in q.leaves for t in range(x[0], x[1] + 1)],
                                   "a int, n long, kind long, low array<double>, high array<double>")
    open_ = q.rows.select("*", *[F.lit(float("inf")).alias(c) for c in limit])
    # the home of a query tile is the donor tile closest to its largest leaf
    home = stage(_tile_pairs(leaves.withColumn("reach", F.lit(float("nan"))), d, nan_euclidean).groupBy("a").agg(
        F.max_by("b", F.struct("n", "b")).alias("b")), "knn_pairs")
    first = met(open_, home)
    if d.tiles == 1:
        return result(first)
    first = stage(first, "knn_home")
    # a query's limits: its k-th distances at home; a column it has asks nothing
    kth = first.where(F.col("_rk") == k).groupBy(F.col("_q").alias("_id")).agg(*[
        F.min(F.when(F.col("_col") == c, F.col("_d2"))).alias(f"_k{i}") for i, c in enumerate(names)])
    limits = [F.when(F.col(f"_f{columns[i]}").isNull() if c else F.lit(True), F.coalesce(f"_k{i}", F.lit(float("inf")))).otherwise(F.lit(-1.0)).alias(limit[i])
              for i, c in enumerate(names)]
    bounded = stage(q.rows.join(kth, "_id", "left").select("_id", "_tile", *feats, *limits), "knn_limits")
    reach = bounded.groupBy(F.col("_tile").alias("a")).agg(F.greatest(*[F.max(c) for c in limit], F.lit(-1.0)).alias("reach"))
    pairs = stage(_tile_pairs(leaves.join(reach, "a"), d, nan_euclidean).select("a", "b").distinct().join(
        home.select("a", "b"), ["a", "b"], "left_anti"), "knn_pairs")
    both = first.unionByName(met(bounded, pairs)).drop("_rk")
    w = Window.partitionBy("_q", "_col").orderBy("_d2", "_d")
    return result(both.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k))
