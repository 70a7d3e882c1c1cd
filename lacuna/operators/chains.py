"""Chained imputation with other conditionals: boosted trees (I-06, I-07), a
linear support vector regression (I-04) and a Gaussian process (I-03).

All extend ``MiceImputer``: the state is one narrow table a round, fitted steps
are replayed in one kernel.  A conditional is fitted over *blocks*: the rows
where its column is known, as arrays of many rows in one value, kept by Spark
(memory or disk) while the column is fitted and recomputed from the state if
an executor is lost.  Each pass over the blocks adds up a vector of sums of
fixed length in every task; the tasks' vectors are added in Spark, and only the
sum reaches the driver.

A solver (``TreeSolver``, ``VectorSolver``) is written against these sums alone.
A fit takes dozens of passes, and of a chain of at most ``TASK_ROWS`` rows (times
the chain's ``reach``) each would be a job of a few milliseconds' work: there a
whole round is solved in the one task that holds the block, whose sums are the
whole ones already, and a round is one job.  A conditional of a single pass (the
Gaussian process) always takes a job, over ``PASS_ROWS`` rows a task or more.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.mice import MiceImputer, _Replay
from lacuna.session import stage, unstage

#: Rows of a partition of the state.
PARTITION_ROWS = 65_536
#: A state of at most so many rows is one block, about 20 bytes a row and column.
TASK_ROWS = 262_144
#: Least rows of a partition of a chain whose conditionals take one pass.
PASS_ROWS = 8_192
#: Task vectors that are small enough to be added on the driver: tasks x length.
DIRECT_CELLS = 1 << 20


class BlockChain(MiceImputer):
    """The shared part: blocks and sums.  A chain gives ``_plan``."""
    #: Blocks of ``TASK_ROWS`` that one task solves.
    reach = 1
    moved = None

    def _plan(self, column: int, rnd: int):
        """(solver, encode, make) of a column, or None: ``make`` gives the step
        from what the solver returns; it and ``encode`` travel with the task."""
        raise NotImplementedError

    def _noted(self, column: int, got) -> None:
        """Keeps what the next round's plan takes from a solution."""

    def _beside(self) -> bool:
        """Whether rounds are solved in one task."""
        return self.n <= TASK_ROWS * self.reach

    def _partitions(self) -> int:
        return 1 if self._beside() else -(-self.n // PARTITION_ROWS)

    def _opened(self, df: DataFrame) -> DataFrame:
        opened = super()._opened(df)
        return opened.coalesce(self._partitions()) if self.fitting else opened

    def _start(self, train: DataFrame) -> None:
        super()._start(train)
        self.fitting = True

    def fit(self, train: DataFrame):
        self._start(train)
        state = stage(self._opened(train).select("*", *self._round_draws(0)), "chain")
        self.steps = []
        for rnd in range(self.rounds):
            own, after = self._round(state, rnd)
            self.steps += own
            if rnd + 1 < self.rounds:
                if self._settled(state, own):
                    break
                nxt = stage(after.select("*", *self._round_draws(rnd + 1)), "chain")
                unstage(state)
                state = nxt
            self._release()
        self._release()
        unstage(state)
        self.fitting = False
        return self

    def _release(self) -> None:
        """Frees what a round has kept, once the state after it is staged."""

    def _conditional(self, state: DataFrame, own: list, column: int, rnd: int):
        plan = self._plan(column, rnd)
        if plan is None:
            return None
        solver, encode, make = plan
        got = self._solved(state, own, column, solver, encode)
        self._noted(column, got)
        return make(got)

    def _round(self, state: DataFrame, rnd: int) -> tuple:
        """The fitted steps of a round and the state after them."""
        self.moved, own = None, []
        if not self._beside():
            for c in self.order:
                step = self._conditional(state, own, c, rnd)
                if step is not None:
                    own.append(step)
            return own, self._after(state, own)
        plans = [(c, self._plan(c, rnd)) for c in self.order]

        def emit(_, missing, x):
            return pa.RecordBatch.from_arrays([pa.array([missing.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                                              ["missing", "x"])

        kernel = whole_round(plans, _Replay(self.lo, self.hi))
        found = pickle.loads(self._replayed(state, [], emit, "missing binary, x binary").coalesce(1)
                             .mapInArrow(kernel, "v binary").first()["v"])
        solved, self.moved = found
        for (c, plan), got in zip(plans, solved):
            if plan is None:
                continue
            self._noted(c, got)
            step = plan[2](got)
            if step is not None:
                own.append(step)
        return own, self._after(state, own)

    def _blocks(self, state: DataFrame, own: list, column: int, encode=None) -> DataFrame:
        """(n, x, y): known rows of a column; x is row-major, or what ``encode``
        makes of the other columns."""
        def emit(_, missing, x):
            n, others, y = known(missing, x, column, encode)
            return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([others], pa.binary()), pa.array([y.tobytes()], pa.binary())],
                                              ["n", "x", "y"])

        return self._replayed(state, own, emit, "n long, x binary, y binary")

    def _solved(self, state: DataFrame, own: list, column: int, solver, encode=None):
        """``solver.solve(sums)`` over the blocks of a column, where
        ``sums(length, add)`` is the sum of ``add(n, x bytes, y, memo)``; ``memo``
        is a dict that stays with a block as long as the block does."""
        blocks = self._blocks(state, own, column, encode)
        if self._beside():
            return pickle.loads(blocks.coalesce(1).mapInArrow(in_task(solver), "v binary").first()["v"])
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        tasks = state.rdd.getNumPartitions()
        try:
            return solver.solve(lambda length, add: spark_sums(blocks, tasks, length, add))
        finally:
            blocks.unpersist()

    def _settled(self, state: DataFrame, own: list) -> bool:
        """No cell moved by ``tol`` of the largest observed size."""
        if self.sample_posterior:
            return False
        moved = self.moved
        if moved is None:
            def emit(_, missing, change):
                return pa.RecordBatch.from_arrays([pa.array([float(np.abs(change).max(initial=0.0))])], ["moved"])
            moved = self._replayed(state, own, emit, "moved double", changes=True).agg(F.max("moved")).first()[0]
        scale = float(max(np.abs(self.lo).max(), np.abs(self.hi).max()))
        return moved is None or moved < self.tol * scale


def known(missing: np.ndarray, x: np.ndarray, column: int, encode) -> tuple:
    """(n, bytes of the other columns, y) of the rows where a column is known."""
    seen = ~missing[:, column]
    others = np.delete(x[seen], column, axis=1)
    return int(seen.sum()), (others if encode is None else encode(others)).tobytes(), x[seen, column]


def solved_beside(solver, parts: list):
    """A solution from blocks that one task holds."""
    if hasattr(solver, "beside"):
        return solver.beside(parts)
    return solver.solve(lambda length, add: block_sums(parts, length, add))


def whole_round(plans: list, replay):
    """The solutions of a round's columns, each beside the values that the
    columns before it left, and the largest change of a cell."""
    def kernel(batches):
        p, flags, values = len(plans), [], []
        for b in batches:
            for m, x in zip(b.column(0), b.column(1)):
                flags.append(np.frombuffer(m.as_buffer(), bool).reshape(-1, p))
                values.append(np.frombuffer(x.as_buffer()).reshape(-1, p))
        values = [x.copy() for x in values]
        before, solved = [x.copy() for x in values], []
        for column, plan in plans:
            if plan is None:
                solved.append(None)
                continue
            solver, encode, make = plan
            seen = [known(missing, x, column, encode) for missing, x in zip(flags, values)]
            got = solved_beside(solver, [(n, others, y.tobytes(), {}) for n, others, y in seen])
            solved.append(got)
            step = make(got)
            for missing, x in zip(flags, values):
                if step is not None:
                    replay.step(x, missing, step, None)
        moved = max([float(np.abs(x - old).max(initial=0.0)) for x, old in zip(values, before)], default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((solved, moved))], pa.binary())], ["v"])
    return kernel


def block_sums(parts, length: int, add) -> np.ndarray:
    total = np.zeros(length)
    for n, x, y, memo in parts:
        if n:
            total += add(n, x, np.frombuffer(y), memo)
    return total


def rows_of(batches):
    for b in batches:
        for n, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            yield n, x.as_buffer(), y.as_buffer(), {}


def in_task(solver):
    """The solver beside the only partition's blocks."""
    def kernel(batches):
        out = solved_beside(solver, list(rows_of(batches)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["v"])
    return kernel


def spark_sums(blocks: DataFrame, tasks: int, length: int, add) -> np.ndarray:
    def kernel(batches):
        total = block_sums(rows_of(batches), length, add)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def spread(batches):
        v = block_sums(rows_of(batches), length, add)
        k = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v[k])], ["k", "v"])

    out = np.zeros(length)
    if tasks * length <= DIRECT_CELLS:
        for r in blocks.mapInArrow(kernel, "v binary").collect():
            out += np.frombuffer(r["v"])
    else:
        for r in blocks.mapInArrow(spread, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r["k"]] = r["v"]
    return out


# ------------------------------------------------------------- boosted trees

@dataclass
class TreesStep:
    """Boosted trees over binned columns; trees are heaps of one depth."""
    column: int
    rnd: int
    base: float
    edges: list
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def codes(self, others: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, others[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def predict(self, others: np.ndarray):
        return self.base + boosted(self.codes(others), self.feature, self.cut, self.leaf), None


def nodes_of(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Heap position of each row at ``depth``; a node sends codes above its
    cut to the right."""
    node, row = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
    for _ in range(depth):
        node = 2 * node + 1 + (codes[feature[node], row] > cut[node])
    return node


def boosted(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    out = np.zeros(codes.shape[1])
    for f, c, v in zip(feature, cut, leaf):
        out += v[nodes_of(codes, f, c, len(v).bit_length() - 1) - (len(v) - 1)]
    return out


def histogram(codes: np.ndarray, residual: np.ndarray, node: np.ndarray, nodes: int, bins: int, pairs: list) -> np.ndarray:
    """(nodes, pairs, bins, bins, 2): rows and residual sums for pairs of
    columns; a pair of one column twice has it on the diagonal alone."""
    out = np.zeros((len(pairs), nodes * bins * bins, 2))
    for k, (f, g) in enumerate(pairs):
        at = (node * bins + codes[f]) * bins + codes[g]
        out[k, :, 0] = np.bincount(at, minlength=nodes * bins * bins)
        out[k, :, 1] = np.bincount(at, residual, minlength=nodes * bins * bins)
    return out.reshape(len(pairs), nodes, bins, bins, 2).swapaxes(0, 1)


def best_split(hist: np.ndarray, penalty: float, least: float):
    """(feature, cut) of the best split of a (columns, bins, 2) histogram; a
    node without a gain sends all rows to the left.  Ties: the first column,
    then the lowest cut."""
    left = np.cumsum(hist, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    score = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0] + penalty, 1e-300)
    gain = score(left) + score(right) - score(whole)
    gain[(left[..., 0] < least) | (right[..., 0] < least) | (left[..., 0] == 0) | (right[..., 0] == 0)] = -np.inf
    at = int(gain.argmax())
    if not gain.flat[at] > 1e-9 * max(float(score(whole).max()), 1e-300):
        return 0, hist.shape[1] - 1
    return divmod(at, hist.shape[1])


def best_splits(hist: np.ndarray, penalty: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """``best_split`` of each node of a (nodes, columns, bins, 2) histogram."""
    nodes, _, bins, _ = hist.shape
    left = np.cumsum(hist, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    score = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0] + penalty, 1e-300)
    with np.errstate(over="ignore"):
        gain = score(left) + score(right) - score(whole)
    gain[(left[..., 0] < least) | (right[..., 0] < least) | (left[..., 0] == 0) | (right[..., 0] == 0)] = -np.inf
    gain = gain.reshape(nodes, -1)
    at = gain.argmax(axis=1)
    some = gain[np.arange(nodes), at] > 1e-9 * np.maximum(score(whole).reshape(nodes, -1).max(axis=1), 1e-300)
    return np.where(some, at // bins, 0), np.where(some, at % bins, bins - 1)


class NodeRows:
    """The rows of all blocks at the nodes of a tree.  A step goes through all rows
    at once and writes into arrays that are taken once: getting and clearing new
    ones costs more than the step.  Residuals are added up block by block, as the
    passes over Spark's blocks add them."""

    def __init__(self, codes: np.ndarray, residual: np.ndarray, ends: np.ndarray, bins: int):
        q, n = codes.shape
        self.codes, self.residual, self.bins = codes.astype(np.int64), residual, bins
        self.spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
        self.flat, self.row, self.rows = self.codes.ravel(), np.arange(n), {}
        self.node, self.first, self.code, self.base, self.head, self.at, self.other = (np.zeros(n, np.int64) for _ in range(7))
        self.mask, self.value = np.zeros(n, bool), np.zeros(n)

    def counted(self, cells: int, indices, key) -> np.ndarray:
        """(indices, cells, 2): rows and residual sums by each index; rows
        of the same ``key`` are the same in every tree."""
        out = []
        for j, at in enumerate(indices):
            rows = self.rows.get((key, j))
            if rows is None:
                rows = np.bincount(at, minlength=cells)
                if key is not None:
                    self.rows[key, j] = rows
            a, b = self.spans[0]
            total = np.bincount(at[a:b], self.residual[a:b], cells)
            for a, b in self.spans[1:]:
                total += np.bincount(at[a:b], self.residual[a:b], cells)
            out.append(np.column_stack([rows, total]))
        return np.stack(out)

    def margins(self, width: int) -> np.ndarray:
        """By node and code of each column."""
        np.multiply(self.node, self.bins, out=self.base)
        return self.counted(width * self.bins, (np.add(self.base, c, out=self.at) for c in self.codes), "all" if width == 1 else None)

    def _split_code(self, f: np.ndarray) -> None:
        """Each row's split column and its code there."""
        np.take(f, self.node, out=self.first, mode="clip")
        np.multiply(self.first, len(self.row), out=self.at)
        self.at += self.row
        np.take(self.flat, self.at, out=self.code, mode="clip")

    def pairs(self, width: int, f: np.ndarray) -> np.ndarray:
        """By node and the codes of the split column and each column; a pair has
        its lower column first."""
        bins, least, high = self.bins, int(f.min()), int(f.max())
        self._split_code(f)
        np.multiply(self.node, bins * bins, out=self.base)
        np.multiply(self.code, bins, out=self.head)
        self.head += self.base
        self.base += self.code

        def index(g):
            if g < high:
                np.multiply(self.codes[g], bins, out=self.at)
                self.at += self.base
            if g >= least:
                np.add(self.head, self.codes[g], out=self.other)
                if g >= high:
                    return self.other
                np.copyto(self.at, self.other, where=np.less_equal(self.first, g, out=self.mask))
            return self.at
        return self.counted(width * bins * bins, (index(g) for g in range(len(self.codes))), least if width == 1 else None)

    def descend(self, f: np.ndarray, c: np.ndarray) -> None:
        self._split_code(f)
        np.take(c, self.node, out=self.at, mode="clip")
        np.multiply(self.node, 2, out=self.node)
        self.node += np.greater(self.code, self.at, out=self.mask)

    def less(self, leaf: np.ndarray) -> None:
        np.take(leaf, self.node, out=self.value, mode="clip")
        self.residual -= self.value


@dataclass
class TreeSolver:
    """Boosted trees from sums of pair histograms."""
    q: int
    bins: int
    trees: int
    depth: int
    rate: float
    penalty: float
    least: float
    base: float

    def _two_levels(self, hist: np.ndarray, of: dict):
        """Splits of a node and of its two children from its pair histogram."""
        q = self.q
        margin = np.stack([hist[of[f, f]].sum(axis=0) for f in range(q)])
        feature, cut = best_split(margin, self.penalty, self.least)
        out = [(feature, cut)]
        for side in (slice(None, cut + 1), slice(cut + 1, None)):
            # a pair has its lower column first
            child = np.stack([hist[of[feature, g]][side].sum(axis=0) if g >= feature else hist[of[g, feature]][:, side].sum(axis=1)
                              for g in range(q)])
            out.append(best_split(child, self.penalty, self.least))
        return out

    def beside(self, parts: list):
        """The trees of ``solve``, sum by sum, from blocks at hand: rows are kept
        at their nodes, and of the pairs only those of the split column counted."""
        q, bins, depth = self.q, self.bins, self.depth
        parts = [(np.frombuffer(x, np.uint8).reshape(q, n), np.frombuffer(y)) for n, x, y, _ in parts if n] or [(np.zeros((q, 0), np.uint8), np.zeros(0))]
        rows = NodeRows(np.concatenate([c for c, _ in parts], axis=1), np.concatenate([y for _, y in parts]) - self.base,
                        np.cumsum([0] + [len(y) for _, y in parts]), bins)
        inner, seen = (1 << depth) - 1, False
        feature, cut, leaf = (np.zeros((self.trees, k), t) for k, t in ((inner, np.int64), (inner, np.int64), (inner + 1, float)))
        for t in range(self.trees):
            rows.node[:] = 0
            level = 0
            while level < depth:
                width = 1 << level
                margin = rows.margins(width).reshape(q, width, bins, 2).swapaxes(0, 1)
                f, c = best_splits(margin, self.penalty, self.least)
                feature[t, width - 1:2 * width - 1], cut[t, width - 1:2 * width - 1] = f, c
                if level + 2 > depth:
                    total = np.cumsum(margin[np.arange(width), f], axis=1)
                    left = total[np.arange(width), c]
                    both = np.stack([left, total[:, -1] - left], axis=1).reshape(-1, 2)
                    leaf[t] = np.where(both[:, 0] > 0, self.rate * both[:, 1] / np.maximum(both[:, 0] + self.penalty, 1e-300), 0.0)
                    seen = seen or total[:, -1, 0].max() > 1
                    rows.descend(f, c)
                    break

                pairs = rows.pairs(width, f).reshape(q, width, bins, bins, 2)
                child = np.stack([np.stack([h[k][side].sum(axis=0) if g >= f[k] else h[k][:, side].sum(axis=1)
                                            for g, h in enumerate(pairs)])
                                  for k in range(width) for side in (slice(None, c[k] + 1), slice(c[k] + 1, None))])
                rows.descend(f, c)
                f, c = best_splits(child, self.penalty, self.least)
                feature[t, 2 * width - 1:4 * width - 1], cut[t, 2 * width - 1:4 * width - 1] = f, c
                rows.descend(f, c)
                level += 2
            if depth % 2 == 0:
                h = rows.counted(inner + 1, [rows.node], None)[0]
                leaf[t] = np.where(h[:, 0] > 0, self.rate * h[:, 1] / np.maximum(h[:, 0] + self.penalty, 1e-300), 0.0)
                seen = seen or h[:, 0].sum() > 1
            rows.less(leaf[t])
        return feature, cut, leaf, bool(seen)

    def solve(self, sums):
        """(features, cuts, leaves, whether two rows were seen)."""
        q, bins, depth = self.q, self.bins, self.depth
        inner = (1 << depth) - 1
        feature, cut, leaf = np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1))
        both = [(f, g) for f in range(q) for g in range(f, q)]
        same = [(f, f) for f in range(q)]
        seen, base = False, self.base
        for _ in range(self.trees):
            f, c, v = np.zeros(inner, np.int64), np.full(inner, bins, np.int64), np.zeros(inner + 1)
            done = (feature, cut, leaf)

            def hist(pairs, level):
                def add(n, x, y, memo):
                    codes = np.frombuffer(x, np.uint8).reshape(q, n)
                    known, residual = memo.get("residual", (0, None))
                    if residual is None or known < len(done[0]):
                        residual = (y - base if residual is None else residual) - boosted(codes, *(t[known:] for t in done))
                        memo["residual"] = len(done[0]), residual
                    node = nodes_of(codes, f, c, level) - ((1 << level) - 1)
                    return histogram(codes, residual, node, 1 << level, bins, pairs).ravel()
                shape = (1 << level, len(pairs), bins, bins, 2)
                return sums(int(np.prod(shape)), add).reshape(shape)

            level = 0
            while level < depth:
                two = level + 2 <= depth
                pairs = both if two else same
                of = {p: k for k, p in enumerate(pairs)}
                h = hist(pairs, level)
                first = (1 << level) - 1
                for k in range(1 << level):
                    node = first + k
                    if two:
                        (f[node], c[node]), *rest = self._two_levels(h[k], of)
                        for child, (cf, cc) in zip((2 * node + 1, 2 * node + 2), rest):
                            f[child], c[child] = cf, cc
                    else:
                        margin = np.stack([h[k, of[j, j]].sum(axis=0) for j in range(q)])
                        f[node], c[node] = best_split(margin, self.penalty, self.least)
                        total = np.cumsum(margin[f[node]], axis=0)
                        left, right = total[c[node]], total[-1] - total[c[node]]
                        for side, (rows, part) in enumerate((left, right)):
                            v[2 * k + side] = self.rate * part / (rows + self.penalty) if rows > 0 else 0.0
                        seen = seen or total[-1][0] > 1
                level += 2 if two else 1
            if depth % 2 == 0:   # the leaves' sums take a pass of their own
                h = hist(same[:1], depth)[:, 0].sum(axis=(1, 2))
                v = np.where(h[:, 0] > 0, self.rate * h[:, 1] / np.maximum(h[:, 0] + self.penalty, 1e-300), 0.0)
                seen = seen or h[:, 0].sum() > 1
            feature, cut, leaf = np.vstack([feature, f[None]]), np.vstack([cut, c[None]]), np.vstack([leaf, v[None]])
        return feature, cut, leaf, bool(seen)


#: Learning rate, leaf penalty and least rows of a leaf of the two boosting presets.
PRESETS = {"xgb": (0.3, 1.0, 1.0), "lgbm": (0.1, 0.0, 20.0)}


class BoostedChain(BlockChain):
    """I-06, I-07: chained boosted trees, 20 of depth 5, without draws.

    Columns are binned once, at quantiles of the known training values.  A pass
    adds up histograms of column *pairs* for the open nodes, which decide two
    levels of a tree: the first from the margins, the second from the pairs
    with the first one's column.  A tree of depth 5 takes three passes, each a job
    of its own; a million rows are solved in one task before that pays."""
    reach = 4

    def __init__(self, cols, preset: str = "xgb", trees: int = 20, depth: int = 5, bins: int = 32, tol: float = 1e-3, **options):
        super().__init__(cols, sample_posterior=False, **options)
        (self.rate, self.penalty, self.least), self.trees, self.depth, self.bins, self.tol = PRESETS[preset], trees, depth, bins, tol

    def _start(self, train: DataFrame) -> None:
        super()._start(train)
        share = [(k + 1) / self.bins for k in range(self.bins - 1)]
        marks = train.agg(*[F.percentile_approx(F.col(c).cast("double"), share, 10_000).alias(c) for c in self.cols]).first()
        self.edges = [np.unique(np.array(marks[c] if marks[c] is not None else [], float)) for c in self.cols]

    def _plan(self, column: int, rnd: int):
        q = len(self.cols) - 1
        if not q:
            return None
        edges, base = [e for j, e in enumerate(self.edges) if j != column], float(self.means[column])
        empty = np.zeros((0, 0))
        coder = TreesStep(column, rnd, base, edges, empty, empty, empty)
        solver = TreeSolver(q, self.bins, self.trees, self.depth, self.rate, self.penalty, self.least, base)
        return solver, coder.codes, lambda got: TreesStep(column, rnd, base, edges, *got[:3]) if got[3] else None


# ------------------------------------------------ support vector regression

@dataclass
class LinearStep:
    column: int
    rnd: int
    coef: np.ndarray
    intercept: float

    def predict(self, others: np.ndarray):
        return self.intercept + others @ self.coef, None


class SupportVectorChain(BlockChain):
    """I-04: chained linear regressions with the epsilon-insensitive loss:
    the least of |(w, b)|^2 / 2 + cost * sum(max(0, |y - x w - b| - epsilon)),
    without draws.

    The loss is half of |r - epsilon| + |r + epsilon| less epsilon, and each
    absolute value lies below a parabola that touches it at the last residual.
    A pass adds up the parabolas' normal equations (p * p + p sums), whose
    solution lowers the loss; passes end when the coefficients stand still.
    Columns are centred and scaled inside, the penalty is on the given scale."""

    def __init__(self, cols, cost: float = 1.0, epsilon: float = 0.0, passes: int = 40, stop: float = 1e-5, tol: float = 1e-3, **options):
        super().__init__(cols, sample_posterior=False, **options)
        self.cost, self.epsilon, self.passes, self.stop, self.tol, self.last = cost, epsilon, passes, stop, tol, {}

    def _noted(self, column: int, got) -> None:
        self.last[column] = got[0]

    def _plan(self, column: int, rnd: int):
        q = len(self.cols) - 1
        mean = np.delete(self.means, column)
        scale = np.maximum(np.delete(np.maximum(np.abs(self.hi - self.means), np.abs(self.lo - self.means)), column), 1e-12)
        unit = max(float(max(abs(self.hi[column] - self.means[column]), abs(self.lo[column] - self.means[column]))), 1e-12)
        # z = ((x - mean) / scale, 1): w = u / scale, b = u0 + centre - mean w
        back = np.zeros((q + 1, q + 1))
        back[:q, :q], back[q, :q], back[q, q] = np.diag(1 / scale), -mean / scale, 1.0
        shift = np.append(np.zeros(q), float(self.means[column]))
        solver = VectorSolver(mean, scale, float(self.means[column]), self.epsilon, 1e-7 * unit, self.cost, back, shift,
                              self.passes, self.stop, self.last.get(column, np.zeros(q + 1)))

        def make(got):
            w = back @ got[0] + shift
            return LinearStep(column, rnd, w[:q], float(w[q])) if got[1] >= 2 else None
        return solver, None, make


@dataclass
class VectorSolver:
    """Coefficients from sums of the parabolas' normal equations."""
    mean: np.ndarray
    scale: np.ndarray
    centre: float
    epsilon: float
    touch: float
    cost: float
    back: np.ndarray
    shift: np.ndarray
    passes: int
    stop: float
    start: np.ndarray

    def solve(self, sums):
        """(coefficients, rows)."""
        q, u, n = len(self.mean), self.start, 0.0
        mean, scale, centre, epsilon, touch = self.mean, self.scale, self.centre, self.epsilon, self.touch
        for _ in range(self.passes):
            at = u

            def add(n, x, y, memo):
                z = np.column_stack([(np.frombuffer(x).reshape(n, q) - mean) / scale, np.ones(n)])
                r = y - centre - z @ at
                near, far = (0.5 / np.maximum(np.abs(r + e), touch) for e in (-epsilon, epsilon))
                weighted = z * (near + far)[:, None]
                return np.concatenate([(z.T @ weighted).ravel(), z.T @ (near * (y - centre - epsilon) + far * (y - centre + epsilon)), [n]])
            total = sums((q + 1) ** 2 + q + 2, add)
            n = total[-1]
            gram, right = total[:(q + 1) ** 2].reshape(q + 1, q + 1), total[(q + 1) ** 2:-1]
            # the penalty |back u + shift|^2 / 2
            u = np.linalg.lstsq(self.cost * gram + self.back.T @ self.back, self.cost * right - self.back.T @ self.shift, rcond=None)[0]
            if np.abs(u - at).max() <= self.stop * max(np.abs(u).max(), 1e-300):
                break
        return u, n


# ------------------------------------------------------------ Gaussian process

@dataclass
class ProcessStep:
    """A Gaussian process in the space of random Fourier features."""
    column: int
    rnd: int
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    spread: np.ndarray
    centre: float
    unit: float
    noise: float

    def predict(self, others: np.ndarray):
        phi = fourier((others - self.mean) / self.scale, self.frequency, self.phase)
        var = self.noise * (1.0 + np.einsum("ij,ij->i", phi @ self.spread, phi))
        return self.centre + self.unit * (phi @ self.weight), self.unit * np.sqrt(np.maximum(var, 1e-24))


def fourier(z: np.ndarray, frequency: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Features whose products approach exp(-|a - b|^2 / 2)."""
    return np.sqrt(2.0 / len(phase)) * np.cos(z @ frequency + phase)


def inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of a symmetric positive definite matrix, column by column
    (element-wise steps only: threaded libraries may hang beside a JVM)."""
    a = a.copy()
    for k in range(len(a)):
        pivot, column = a[k, k], a[:, k].copy()
        row = a[k] / pivot
        a -= column[:, None] * row[None, :]
        a[k], a[:, k] = row, -column / pivot
        a[k, k] = 1.0 / pivot
    return a


@dataclass
class FeatureSums:
    """The Gram matrix of the features, their products with y, the rows."""
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    centre: float
    unit: float

    def solve(self, sums):
        (q, d), s = self.frequency.shape, self

        def add(n, x, y, memo):
            out = np.zeros(d * d + d + 1)
            x = np.frombuffer(x).reshape(n, q)
            for k in range(0, n, 4096):
                phi = fourier((x[k:k + 4096] - s.mean) / s.scale, s.frequency, s.phase)
                out[:d * d] += (phi.T @ phi).ravel()
                out[d * d:-1] += phi.T @ ((y[k:k + 4096] - s.centre) / s.unit)
            out[-1] = n
            return out
        return sums(d * d + d + 1, add)


class GaussianProcessChain(BlockChain):
    """I-03: chained Gaussian processes with a squared-exponential kernel over
    standardised columns, posterior draws within the train range.

    The kernel is replaced by ``features`` random Fourier features, whose
    frequencies are keyed by seed and column: the process becomes a ridge
    regression, for which one pass adds up the features' Gram matrix.  Its
    error against the exact process falls with the root of ``features``.  The
    reference leaves columns unscaled and adds almost no noise; both make every
    prediction fall back to the prior, so this operator scales columns and
    takes a share ``noise`` of the column's variance."""

    def __init__(self, cols, features: int = 256, length: float = 1.0, noise: float = 0.05, **options):
        super().__init__(cols, sample_posterior=True, **options)
        self.features, self.length, self.noise, self.kept = features, length, noise, []

    def _start(self, train: DataFrame) -> None:
        super()._start(train)
        self.slots = train.sparkSession.sparkContext.defaultParallelism
        dev = train.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in self.cols]).first()
        self.dev = np.array([float(dev[c] or 0.0) or 1.0 for c in self.cols])

    def _beside(self) -> bool:
        return False

    def _partitions(self) -> int:
        return max(-(-self.n // PARTITION_ROWS), min(-(-self.n // PASS_ROWS), self.slots))

    def _opened(self, df: DataFrame) -> DataFrame:
        opened = MiceImputer._opened(self, df)
        return opened.repartition(max(1, self._partitions())) if self.fitting else opened

    def _round(self, state: DataFrame, rnd: int) -> tuple:
        """Each step is replayed once: the state after it stays with Spark until
        the next column is fitted on it."""
        own, cur, self.kept = [], state, []
        for k, c in enumerate(self.order):
            step = self._conditional(cur, [], c, rnd)
            while len(self.kept) > 1:   # the newer state is there now
                self.kept.pop(0).unpersist()
            if step is None:
                continue
            own.append(step)
            rest = tuple(f"_u{i}" for i in self.order[k + 1:])
            cur = self._after(cur, [step], rest).persist(StorageLevel.MEMORY_AND_DISK)
            self.kept.append(cur)
        p = len(self.cols)
        return own, cur.select(self.row_id, *[f"_m{i}" for i in range(p)], *[f"_x{i}" for i in range(p)])

    def _release(self) -> None:
        for state in self.kept:
            state.unpersist()
        self.kept = []

    def _solved(self, state: DataFrame, own: list, column: int, solver, encode=None):
        blocks = self._blocks(state, own, column, encode)
        return solver.solve(lambda length, add: spark_sums(blocks, self._partitions(), length, add))

    def _plan(self, column: int, rnd: int):
        q, d = len(self.cols) - 1, self.features
        rng = np.random.default_rng([self.seed, column])
        frequency, phase = rng.normal(0.0, 1.0 / self.length, (q, d)), rng.uniform(0.0, 2 * np.pi, d)
        mean, scale = np.delete(self.means, column), np.delete(self.dev, column)
        centre, unit = float(self.means[column]), float(self.dev[column])
        noise = self.noise

        def make(total):
            if total[-1] < 2:
                return None
            spread = inverse(total[:d * d].reshape(d, d) + noise * np.eye(d))
            weight = (spread * total[d * d:-1]).sum(axis=1)
            return ProcessStep(column, rnd, mean, scale, frequency, phase, weight, spread, centre, unit, noise)
        return FeatureSums(mean, scale, frequency, phase, centre, unit), None, make
