"""Chained-equation imputation (I-01, I-02, I-10, I-11; the base of I-03, I-04,
I-06 and I-07 in ``chains``).

``MiceImputer`` uses Bayesian ridge conditionals with posterior draws.  Per
round and column the regression needs only sufficient statistics of the rows
where the column is observed.  One Arrow kernel replays the steps of the round
so far and emits its task's sums, which are added on the driver; the evidence
iteration runs on the p x p result.  The state of the training rows is staged
once per round, as arrays of some thousand rows in one value (``StateBlock``):
a pass over dozens of columns would spend its time on moving single values
between the JVM and Python.  ``transform`` is row-local: all fitted steps are
replayed in one kernel without any stage.

Steps of other kinds are in ``chains``.  ``TreeChain`` uses Spark ML forests as conditionals, without
draws.  All clip to the training range and round the codes half to even.

Draws are keyed by (seed, round, column, row id), so completions do not
depend on partitioning, and only missing cells draw, once a round, in the task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.clean import round_half_even
from lacuna.functions.draws import key_bytes, uniform, uniforms
from lacuna.session import stage, unstage

#: The shapes and rates of the precisions' gamma priors.
PRIOR = 1e-6
#: Least and most rows of a task of a chain's state.
LEAST_ROWS, MOST_ROWS = 8_192, 262_144
#: Forests of at most so many rows keep the tasks that their table has.
TASK_ROWS = 65_536


def bayesian_ridge(st: dict, max_iter: int = 300, tol: float = 1e-3):
    """Evidence maximisation for y = Xw + b from sufficient statistics.
    Returns (coef, intercept, alpha, sigma, means) with sigma the posterior
    covariance of the coefficients (centred features)."""
    n = st["n"]
    mu = st["sx"] / n
    ybar = st["sy"] / n
    xtx = st["xx"] - n * np.outer(mu, mu)
    xty = st["xy"] - n * mu * ybar
    yty = st["yy"] - n * ybar * ybar
    p = len(mu)
    eig, vec = np.linalg.eigh(xtx)
    eig = np.clip(eig, 0.0, None)
    var_y = yty / n if yty > 0 else 1.0
    alpha, lam = 1.0 / (var_y + np.finfo(float).eps), 1.0
    coef = np.zeros(p)
    for _ in range(max_iter):
        coef_new = vec @ ((vec.T @ xty) / (eig + lam / alpha))
        rss = max(yty - 2 * coef_new @ xty + coef_new @ xtx @ coef_new, 0.0)
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (gamma + 2 * PRIOR) / (float(coef_new @ coef_new) + 2 * PRIOR)
        alpha = (n - gamma + 2 * PRIOR) / (rss + 2 * PRIOR)
        done = np.sum(np.abs(coef - coef_new)) < tol
        coef = coef_new
        if done:
            break
    sigma = vec @ np.diag(1.0 / (alpha * eig + lam)) @ vec.T
    return coef, float(ybar - mu @ coef), float(alpha), sigma, mu


def _normal_table(reach: float = 8.3, per_unit: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    z = np.linspace(-reach, reach, int(2 * reach * per_unit) + 1)
    return z, np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in z])


@dataclass
class Step:
    """One fitted conditional: ``column`` from all others."""
    column: int
    rnd: int
    coef: np.ndarray
    intercept: float
    alpha: float
    sigma: np.ndarray
    mu: np.ndarray

    def predict(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Mean and deviation of the column given the others."""
        d = others - self.mu
        spread = 1.0 / self.alpha + np.einsum("ij,ij->i", d @ self.sigma, d)
        return self.intercept + self.mu @ self.coef + d @ self.coef, np.sqrt(np.maximum(spread, 1e-24))


class _Replay:
    """Fills the missing cells of a (rows x columns) matrix step by step;
    ``table`` is a broadcast ``_normal_table`` where draws are taken."""

    def __init__(self, lo, hi, table=None):
        self.lo, self.hi, self.table, self.posterior = lo, hi, table, table is not None

    def step(self, x: np.ndarray, missing: np.ndarray, st: Step, u: np.ndarray) -> None:
        """``u``: a draw for each row that misses the column, in their order."""
        rows = np.flatnonzero(missing[:, st.column])
        if not len(rows):
            return
        pred, sd = st.predict(np.delete(x[rows], st.column, axis=1))
        lo, hi = self.lo[st.column], self.hi[st.column]
        if self.posterior and sd is not None:
            z, p = self.table.value
            a, b = (np.interp((v - pred) / sd, z, p) for v in (lo, hi))
            pred = pred + sd * np.interp(a + u * (b - a), p, z)
        x[rows, st.column] = np.clip(pred, lo, hi)


def ridge_length(p: int) -> int:
    """Sums that the regression of one of ``p`` columns on the others needs."""
    return 1 + (p - 1) + 2 + (p - 1) + (p - 1) ** 2


def ridge_sums(missing: np.ndarray, x: np.ndarray, mean: np.ndarray, column: int) -> np.ndarray:
    d = x[~missing[:, column]]
    d -= mean
    gram, total, rest = d.T @ d, d.sum(axis=0), np.delete(np.arange(x.shape[1]), column)
    return np.concatenate([[len(d)], total[rest], [total[column], gram[column, column]], gram[rest, column], gram[np.ix_(rest, rest)].ravel()])


def ridge_parts(flat: np.ndarray, p: int) -> dict:
    q = p - 1
    return {"n": flat[0], "sx": flat[1:p], "sy": flat[p], "yy": flat[p + 1], "xy": flat[p + 2:p + 2 + q],
            "xx": flat[p + 2 + q:].reshape(q, q)}


def _matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.column_stack([batch.column(first + i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(n)]) \
        if n else np.zeros((batch.num_rows, 0))


def _sums(flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([flat.astype(float).tobytes()], pa.binary())], ["v"])


def _added(tasks: DataFrame, length: int) -> np.ndarray:
    """The sum of the tasks' vectors (p * p + 2 p + 1 numbers each)."""
    return np.sum([np.frombuffer(r["v"]) for r in tasks.collect()] or [np.zeros(length)], axis=0)


@dataclass
class MiceImputer:
    """Chained Bayesian ridge: start at train means, columns by ascending
    number of missing cells, ``rounds`` rounds, posterior draws within the
    train [min, max]; ``codes`` are rounded half to even in the end."""
    cols: list
    rounds: int = 10
    seed: int = 42
    row_id: str = "row_id"
    sample_posterior: bool = True
    codes: tuple = ()
    steps: list = field(default_factory=list)
    _sent = (None, None)

    def _start(self, train: DataFrame) -> None:
        stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in self.cols], *[F.min(c).alias(f"lo_{c}") for c in self.cols],
                          *[F.max(c).alias(f"hi_{c}") for c in self.cols], *[F.count(c).alias(f"n_{c}") for c in self.cols],
                          F.count(F.lit(1)).alias("rows")).first()
        self.n = stats["rows"]
        of = lambda part: np.array([float(stats[f"{part}_{c}"] or 0.0) for c in self.cols])
        self.means, self.lo, self.hi = of("m"), of("lo"), of("hi")
        seen = of("n")
        self.order = sorted(range(len(self.cols)), key=lambda i: (-seen[i], i))

    def _table(self, spark):
        """The normal table for the tasks, sent once, if draws are taken."""
        sc = spark.sparkContext
        if self.sample_posterior and self._sent[0] != sc.applicationId:
            self._sent = sc.applicationId, sc.broadcast(_normal_table())
        return self._sent[1]

    def _round_draws(self, rnd: int, mark: str = "") -> list:
        """The draws of all steps of a round, staged with its state."""
        if not self.sample_posterior:
            return []
        return [F.when(F.col(f"_m{i}"), uniform(self.seed, f"mice|{rnd}|{c}", self.row_id)).alias(f"_u{mark}{i}")
                for i, c in enumerate(self.cols)]

    def _opened(self, df: DataFrame) -> DataFrame:
        """Row id, missing flags and values with the missing ones at the mean."""
        return df.select(self.row_id, *[F.col(c).isNull().alias(f"_m{i}") for i, c in enumerate(self.cols)],
                         *[F.coalesce(F.col(c).cast("double"), F.lit(float(m))).alias(f"_x{i}")
                           for i, (c, m) in enumerate(zip(self.cols, self.means))])

    def _replayed(self, state: DataFrame, steps: list, emit, schema: str, total: int = 0, keep: tuple = (),
                  changes: bool = False) -> DataFrame:
        """``emit(row ids, missing, x)`` of each batch after ``steps``, which take
        the draws staged with the state, if it has any, or draw in the task.  With ``total`` the
        batches' vectors of that length are added up in the task; columns of the
        state named by ``keep`` follow the emitted ones; with ``changes`` emit
        gets what the steps added to x."""
        p, draws, drawn = len(self.cols), [], self.sample_posterior and bool(steps)
        replay = _Replay(self.lo, self.hi, self._table(state.sparkSession) if steps else None)
        staged = any(c.startswith("_u") for c in state.columns)
        if drawn:
            draws = [F.col(f"_u{s.column}") for s in steps] if staged else [F.col(self.row_id).cast("string").cast("binary").alias("_key")]
        seed, cols = self.seed, list(self.cols)

        def kernel(batches):
            out = np.zeros(total)
            for b in batches:
                if not b.num_rows:
                    continue
                missing, x, u = _matrix(b, 1, p) > 0, _matrix(b, 1 + p, p).copy(), None
                before = x.copy() if changes else None
                if drawn and staged:
                    u = _matrix(b, 1 + 2 * p, len(steps))
                elif drawn:
                    keys = np.array(key_bytes(b.column(1 + 2 * p).to_pylist()), object)
                for k, st in enumerate(steps):
                    gone = missing[:, st.column]
                    replay.step(x, missing, st, None if not drawn else u[gone, k] if staged else
                                uniforms(seed, f"mice|{st.rnd}|{cols[st.column]}", keys[gone]))
                got = emit(b.column(0), missing, x - before if changes else x)
                if total:
                    out += got
                elif keep:
                    yield pa.RecordBatch.from_arrays([*got.columns, *b.columns[-len(keep):]], [*got.schema.names, *keep])
                else:
                    yield got
            if total:
                yield _sums(out)

        return state.select(self.row_id, *[F.col(f"_m{i}").cast("int") for i in range(p)],
                            *[f"_x{i}" for i in range(p)], *draws, *keep).mapInArrow(kernel, schema)

    def _after(self, state: DataFrame, steps: list, keep: tuple = ()) -> DataFrame:
        """The state after ``steps``.  The kernel takes names alone, not the
        imputer with all that it has fitted."""
        p = len(self.cols)
        names = [self.row_id, *[f"_m{i}" for i in range(p)], *[f"_x{i}" for i in range(p)]]

        def emit(row, missing, x):
            return pa.RecordBatch.from_arrays([row, *[pa.array(missing[:, i]) for i in range(p)],
                                               *[pa.array(x[:, i]) for i in range(p)]], names)

        kinds = ["long", *["boolean"] * p, *["double"] * (p + len(keep))]
        return self._replayed(state, steps, emit, ", ".join(f"{c} {k}" for c, k in zip([*names, *keep], kinds)), keep=keep)

    def _ridge(self, st: dict, column: int, rnd: int):
        if st["n"] < 2:
            return None
        coef, b, alpha, sigma, mu = bayesian_ridge(st)
        mean = np.delete(self.means, column)
        return Step(column, rnd, coef, b + self.means[column] - mean @ coef, alpha, sigma, mu + mean)

    def fit(self, train: DataFrame) -> "MiceImputer":
        ViewChain.alone(self).fit(train)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """All columns of ``df`` with the chained ones complete."""
        p, rest = len(self.cols), [c for c in df.columns if c not in self.cols]
        kind = dict(df.dtypes)[self.row_id]
        schema = f"{self.row_id} {kind}, " + ", ".join(f"_x{i} double" for i in range(p))

        def emit(row, _, x):
            return pa.RecordBatch.from_arrays([row, *[pa.array(x[:, i]) for i in range(p)]],
                                              [self.row_id, *[f"_x{i}" for i in range(p)]])

        filled = self._replayed(self._opened(df), self.steps, emit, schema)
        named = filled.select(self.row_id, *[
            (round_half_even(F.col(f"_x{i}")).cast("double") if c in self.codes else F.col(f"_x{i}")).alias(c)
            for i, c in enumerate(self.cols)])
        return named if rest == [self.row_id] else df.select(*rest).join(named, self.row_id)


@dataclass
class StateBlock:
    """Some rows of a chain's state: keys for draws, missing flags, the values
    of each view and its draws for the missing cells, column by column."""
    keys: list
    missing: np.ndarray
    xs: list
    draws: list

    @staticmethod
    def opened(batch: pa.RecordBatch, p: int, m: int) -> "StateBlock":
        """From (key, missing flags, values): all views start alike."""
        missing, x = _matrix(batch, 1, p) > 0, _matrix(batch, 1 + p, p)
        return StateBlock(key_bytes(batch.column(0).to_pylist()), missing, [x.copy() for _ in range(m)], [])

    def drawn(self, salts: list, seeds: list) -> None:
        """A round's draws; ``salts`` has one for each column."""
        keys = np.array(self.keys, object)
        own = [keys[gone] for gone in self.missing.T]
        self.draws = [np.concatenate([uniforms(seed, salt, k) for salt, k in zip(salts, own)]) for seed in seeds]

    def packed(self) -> list:
        """Keys by line, bits, the first view's values and the others' at the
        missing cells (known cells are the same in all views), draws."""
        first, *rest = self.xs
        return [b"\n".join(self.keys), np.packbits(self.missing, axis=1).tobytes(), first.tobytes(),
                b"".join(x[self.missing].tobytes() for x in rest), b"".join(u.tobytes() for u in self.draws)]

    @staticmethod
    def unpacked(row: list, n: int, p: int, m: int) -> "StateBlock":
        keys, bits, first, rest, draws = row
        missing = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(n, -1), axis=1, count=p).view(bool)
        xs = [np.frombuffer(first).reshape(n, p).copy()]
        for own in np.frombuffer(rest).reshape(m - 1, -1) if m > 1 else []:
            x = xs[0].copy()
            x[missing] = own
            xs.append(x)
        return StateBlock(keys, missing, xs, list(np.frombuffer(draws).reshape(m, -1)) if len(draws) else [])

    def replay(self, own: list, replay: _Replay) -> None:
        """Each view after its steps."""
        end = np.cumsum(self.missing.sum(axis=0))
        for v, steps in enumerate(own):
            for st in steps:
                u = self.draws[v][(end[st.column - 1] if st.column else 0):end[st.column]] if self.draws else None
                replay.step(self.xs[v], self.missing, st, u)


#: Columns of a chain's state.
STATE = "n long, keys binary, missing binary, x binary, others binary, draws binary"


def _state_row(block: StateBlock) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([len(block.missing)]), *[pa.array([v], pa.binary()) for v in block.packed()]],
                                      [c.split()[0] for c in STATE.split(", ")])


class ViewChain:
    """I-11: M chained Bayesian ridges that differ in their seed alone, fitted
    in one chain: the state holds the values of all views beside shared missing
    flags, a pass replays each view's steps and adds up the sums of all of them.
    The passes do not grow with M; each view equals its own ``MiceImputer``."""

    def __init__(self, cols: list, m: int = 3, seed: int = 42, rounds: int = 10, row_id: str = "row_id", codes: tuple = ()):
        self._of([MiceImputer(cols, rounds=rounds, seed=seed + v, row_id=row_id, codes=codes) for v in range(m)])

    def _of(self, views: list) -> "ViewChain":
        self.views, self.cols, self.row_id = views, list(views[0].cols), views[0].row_id
        return self

    @classmethod
    def alone(cls, imputer: MiceImputer) -> "ViewChain":
        """The chain of one imputer."""
        return cls.__new__(cls)._of([imputer])

    def _salts(self, rnd: int) -> list:
        return [f"mice|{rnd}|{c}" for c in self.cols]

    def _staged(self, train: DataFrame) -> DataFrame:
        """The first state, dealt to enough tasks."""
        first, p, m = self.views[0], len(self.cols), len(self.views)
        slots = train.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, min(slots, -(-first.n // LEAST_ROWS)), -(-first.n // MOST_ROWS))
        opened = first._opened(train).repartition(tasks, self.row_id)
        salts, seeds, posterior = self._salts(0), [v.seed for v in self.views], first.sample_posterior

        def kernel(batches):
            for b in batches:
                if b.num_rows:
                    block = StateBlock.opened(b, p, m)
                    if posterior:
                        block.drawn(salts, seeds)
                    yield _state_row(block)

        return stage(opened.select(F.col(self.row_id).cast("string").cast("binary").alias("_key"), *[F.col(f"_m{i}").cast("int") for i in range(p)],
                                   *[f"_x{i}" for i in range(p)]).mapInArrow(kernel, STATE), "views")

    def _replayed(self, state: DataFrame, own: list, emit, schema: str, total: int = 0) -> DataFrame:
        """``emit(block)`` of each block after each view's steps: vectors of length
        ``total``, which are added up, or the state's next rows."""
        p, m, first, table = len(self.cols), len(self.views), self.views[0], self.table
        replay = _Replay(first.lo, first.hi, table)

        def kernel(batches):
            out = np.zeros(total)
            for b in batches:
                for k in range(b.num_rows):
                    block = StateBlock.unpacked([c[k].as_buffer() for c in b.columns[1:]], b.column(0)[k].as_py(), p, m)
                    block.replay(own, replay)
                    if total:
                        out += emit(block)
                    else:
                        yield emit(block)
            if total:
                yield _sums(out)

        return state.mapInArrow(kernel, schema)

    def _statistics(self, state: DataFrame, own: list, column: int) -> list:
        p, mean, m = len(self.cols), self.views[0].means, len(self.views)
        length = ridge_length(p)

        def emit(block):
            return np.concatenate([ridge_sums(block.missing, x, mean, column) for x in block.xs])

        flat = _added(self._replayed(state, own, emit, "v binary", m * length), m * length)
        return [ridge_parts(part, p) for part in flat.reshape(m, length)]

    def _next(self, rnd: int):
        """A block's row of the state that round ``rnd`` starts from."""
        salts, seeds, posterior = self._salts(rnd), [v.seed for v in self.views], self.views[0].sample_posterior

        def emit(block):
            text = bytes(block.keys)
            block.keys = text.split(b"\n") if len(block.missing) else []
            if posterior:
                block.drawn(salts, seeds)
            return _state_row(block)
        return emit

    def fit(self, train: DataFrame) -> "ViewChain":
        first = self.views[0]
        first._start(train)
        for view in self.views[1:]:
            view.means, view.lo, view.hi, view.order = first.means, first.lo, first.hi, first.order
        self.table = first._table(train.sparkSession)
        state = self._staged(train)
        for view in self.views:
            view.steps = []
        for rnd in range(first.rounds):
            own: list = [[] for _ in self.views]
            for c in first.order:
                for v, st in enumerate(self._statistics(state, own, c)):
                    step = self.views[v]._ridge(st, c, rnd)
                    if step is not None:
                        own[v].append(step)
            for view, steps in zip(self.views, own):
                view.steps += steps
            if rnd + 1 < first.rounds:
                nxt = stage(self._replayed(state, own, self._next(rnd + 1), STATE), "views")
                unstage(state)
                state = nxt
        unstage(state)
        return self


def completions(train: DataFrame, frames: dict, cols: list, m: int = 3, seed: int = 42, rounds: int = 10,
                row_id: str = "row_id", codes: tuple = ()) -> DataFrame:
    """I-11: M completions of train with seeds s..s+M-1, row-aligned by
    row_id, in long form with a ``view`` column; view 0's imputer also serves
    the other splits (returned under their names in ``split``)."""
    out = None
    for v, imp in enumerate(ViewChain(cols, m, seed, rounds, row_id, codes).fit(train).views):
        for name, f in frames.items():
            if v > 0 and name != "train":
                continue
            t = imp.transform(f).withColumn("view", F.lit(v)).withColumn("split", F.lit(name))
            out = t if out is None else out.unionByName(t)
    return out


@dataclass
class TreeChain:
    """I-02: chained equations with Spark ML forests of 20 trees of depth 5 (the
    reference's setting), predictions clipped to the train range.  Rounds end
    early when no cell moves by ``tol`` of the largest observed size.

    A fit reads its rows nine times; the state after each column stays with
    Spark until the next column is fitted on it, so that a forest is applied once.
    More than ``TASK_ROWS`` rows are dealt to all tasks, by whose number Spark
    ML's bagging differs."""
    cols: list
    rounds: int = 10
    trees: int = 20
    depth: int = 5
    seed: int = 42
    row_id: str = "row_id"
    codes: tuple = ()
    tol: float = 1e-3
    steps: list = field(default_factory=list)

    def _regressor(self, column: str):
        from pyspark.ml.regression import RandomForestRegressor
        return RandomForestRegressor(numTrees=self.trees, featuresCol="_f", labelCol=column, predictionCol="_p",
                                     maxDepth=self.depth, seed=self.seed)

    def _vector(self, df: DataFrame, column: str) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        return VectorAssembler(inputCols=[f"_x_{c}" for c in self.cols if c != column], outputCol="_f").transform(df)

    def _filled(self, state: DataFrame, column: str, model) -> DataFrame:
        out = model.transform(self._vector(state, column))
        value = F.greatest(F.lit(self.lo[column]), F.least(F.lit(self.hi[column]), F.col("_p")))
        return out.withColumn(f"_x_{column}", F.when(F.col(f"_m_{column}"), value).otherwise(F.col(f"_x_{column}"))
                              ).drop("_f", "_p")

    def _opened(self, df: DataFrame) -> DataFrame:
        return df.select(self.row_id, *[F.col(c).isNull().alias(f"_m_{c}") for c in self.cols],
                         *[F.coalesce(F.col(c).cast("double"), F.lit(self.means[c])).alias(f"_x_{c}") for c in self.cols])

    def _dealt(self, df: DataFrame, rows: int) -> DataFrame:
        slots = df.sparkSession.sparkContext.defaultParallelism
        return df if rows <= TASK_ROWS else df.repartition(max(min(slots, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS)), self.row_id)

    def fit(self, train: DataFrame) -> "TreeChain":
        r = train.agg(*[f(c).alias(f"{n}_{c}") for c in self.cols
                        for n, f in (("m", F.avg), ("lo", F.min), ("hi", F.max), ("n", F.count))], F.count(F.lit(1)).alias("rows")).first()
        part = lambda n: {c: float(r[f"{n}_{c}"] or 0.0) for c in self.cols}
        self.means, self.lo, self.hi, seen = part("m"), part("lo"), part("hi"), part("n")
        order = sorted(self.cols, key=lambda c: (-seen[c], self.cols.index(c)))
        state, self.steps = stage(self._dealt(self._opened(train), r["rows"]), "trees"), []
        scale = max([abs(v) for part in (self.lo, self.hi) for v in part.values()], default=0.0)
        for _ in range(self.rounds):
            own, kept = state.withColumns({f"_o_{c}": F.col(f"_x_{c}") for c in self.cols}), []
            for c in order:
                if seen[c] < 2:
                    continue
                model = self._regressor(f"_x_{c}").fit(self._vector(own.where(~F.col(f"_m_{c}")), c))
                self.steps.append((c, model))
                while len(kept) > 1:   # the newer state is there now
                    kept.pop(0).unpersist()
                own = self._filled(own, c, model).persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(own)
            nxt = stage(own, "trees")
            for old in kept:
                old.unpersist()
            unstage(state)
            state = nxt
            moved = state.agg(F.max(F.greatest(*[F.abs(F.col(f"_x_{c}") - F.col(f"_o_{c}")) for c in self.cols], F.lit(0.0)))).first()[0]
            if moved is None or moved < self.tol * scale:
                break   # the chain has settled
        unstage(state)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        cur, per_round = self._dealt(self._opened(df), df.count()), max(1, len(self.cols))
        for k, (c, model) in enumerate(self.steps):
            cur = self._filled(cur, c, model)
            if (k + 1) % per_round == 0 and k + 1 < len(self.steps):
                cur = stage(cur, "trees")   # bounds the plan: one stage a round
        named = cur.select(self.row_id, *[
            (round_half_even(F.col(f"_x_{c}")).cast("double") if c in self.codes else F.col(f"_x_{c}")).alias(c)
            for c in self.cols])
        rest = [c for c in df.columns if c not in self.cols]
        return named if rest == [self.row_id] else df.select(*rest).join(named, self.row_id)


#: I-10: imputers by name.
IMPUTERS = ("mean", "knn", "mice_bayes", "mice_forest", "mice_xgb", "mice_lgbm", "mice_svm", "mice_gp")


def imputer(name: str, cols: list, codes: tuple = (), seed: int = 42, rounds: int = 10):
    """An unfitted imputer by name; unknown names raise."""
    from lacuna.models.knn import KNNImputer
    from lacuna.operators.chains import BoostedChain, GaussianProcessChain, SupportVectorChain
    from lacuna.operators.impute import MeanImputer
    from lacuna.spec import check_choice
    check_choice("imputer", name, IMPUTERS)
    if name == "mean":
        return MeanImputer(cols, codes=codes)
    if name == "knn":
        return KNNImputer(cols, 5, codes=codes)
    options = dict(rounds=rounds, seed=seed, codes=codes)
    if name == "mice_bayes":
        return MiceImputer(cols, **options)
    if name == "mice_forest":
        return TreeChain(cols, **options)
    if name == "mice_svm":
        return SupportVectorChain(cols, **options)
    if name == "mice_gp":
        return GaussianProcessChain(cols, **options)
    return BoostedChain(cols, preset=name.removeprefix("mice_"), **options)
