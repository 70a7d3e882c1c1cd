"""M-03: Gaussian naive Bayes.

Fit = one ``groupBy(class).agg(count, avg, var_pop per feature)`` (partial
aggregation; K rows come back) plus the overall feature variances for the
smoothing term ``var_smoothing * max_j var(x_j)``.  Scoring is a per-batch NumPy
kernel (Arrow): log prior - 1/2 sum(log(2 pi var) + (x - mu)^2 / var), then a
softmax; no join, no shuffle.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.models.base import Recommender, numpy_scores, softmax_rows


#: Cells (rows x classes) that a scoring block holds.
CELLS = 2_000_000


class GaussianNB(Recommender):
    name = "NB"

    def fit(self, train: DataFrame) -> "GaussianNB":
        x = self._prep_fit(train)
        feats, item = self.spec.features, self.spec.item
        smoothing = float(self.params.get("var_smoothing", 1e-9))
        tot = x.agg(*[F.var_pop(c).alias(c) for c in feats]).first()
        eps = smoothing * max(float(tot[c] or 0.0) for c in feats)
        aggs = [F.count(F.lit(1)).alias("_n")]
        for c in feats:
            aggs += [F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}")]
        rows = x.groupBy(item).agg(*aggs).orderBy(item).collect()  # one row per class: the model
        n = sum(r["_n"] for r in rows)
        self.classes = [int(r[item]) for r in rows]
        self.prior = [r["_n"] / n for r in rows]
        self.theta = [[float(r[f"m_{c}"]) for c in feats] for r in rows]
        self.var = [[float(r[f"v_{c}"]) + eps for c in feats] for r in rows]
        self.is_trained = True
        return self

    def state(self) -> dict:
        return {"classes": self.classes, "prior": self.prior, "theta": self.theta, "var": self.var}

    def restore(self, state: dict) -> None:
        self.classes, self.prior, self.theta, self.var = (state[x] for x in ("classes", "prior", "theta", "var"))

    def proba(self, df: DataFrame) -> DataFrame:
        self._check()
        k = self.n_classes
        pos = np.array(self.classes)
        log_prior = np.full(k, -np.inf)
        log_prior[pos] = np.log(np.array(self.prior))
        theta = np.zeros((k, len(self.spec.features)))
        var = np.ones((k, len(self.spec.features)))
        theta[pos] = np.array(self.theta)
        var[pos] = np.array(self.var)
        const = log_prior - 0.5 * np.log(2 * np.pi * var).sum(axis=1)

        step = max(1, CELLS // k)

        def fn(x):
            # a block of rows x classes at a time, features added one by one
            out = np.empty((len(x), k))
            for s in range(0, len(x), step):
                acc = np.repeat(const[None, :], len(x[s:s + step]), axis=0)
                for j in range(x.shape[1]):
                    d = x[s:s + step, j, None] - theta[None, :, j]
                    acc -= 0.5 * d * d / var[None, :, j]
                out[s:s + step] = softmax_rows(acc)
            return out

        return numpy_scores(df, [self.fcol(c) for c in self.spec.features], fn)
