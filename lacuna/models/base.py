"""M-01: the recommender contract over DataFrames.

``fit(train)`` learns small state (bounded by classes x features);
``proba(df)`` adds an ``array<double>`` column ``proba`` (position = class
code 0..K-1); ``topk``/``recommend``/``score`` derive from it without a
second scoring pass (the probabilities are computed once per call).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.scale import ZScore
from lacuna.operators.metrics import score_all
from lacuna.operators.ranking import recommend_wide, topk_long
from lacuna.session import stage
from lacuna.spec import FeatureSpec


def numpy_scores(df: DataFrame, inputs: list[Column], fn, out: str = "proba") -> DataFrame:
    """Append ``out`` = fn(X) per Arrow batch: X is the (rows x inputs)
    float matrix (NaN for NULL), fn returns (rows x K) probabilities.

    Model state travels in ``fn``'s closure (small: classes x features).
    The Arrow UDF is also an optimisation barrier, so the K-way arithmetic is
    never inlined and multiplied into later operators."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in cols])
        return pd.Series(list(np.asarray(fn(x), dtype="float64")))

    return df.withColumn(out, _score(*inputs))


def softmax_rows(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


class Recommender:
    name = "base"

    def __init__(self, spec: FeatureSpec, standardize: bool = True, seed: int = 42, k: int = 3, **params):
        self.spec = spec
        self.standardize = standardize
        self.seed = seed
        self.k = k
        self.params = params
        self.scaler: ZScore | None = None
        self.n_classes: int | None = None
        self.is_trained = False

    # -- shared steps ---------------------------------------------------
    def _prep_fit(self, train: DataFrame) -> DataFrame:
        if self.standardize and self.spec.dense:
            self.scaler = ZScore.fit(train, list(self.spec.dense))
        n = train.agg(F.max(self.spec.item).alias("m")).first()["m"]
        self.n_classes = int(n) + 1
        return self._features(train)

    def _features(self, df: DataFrame) -> DataFrame:
        if not (self.standardize and self.scaler):
            return df
        return df.withColumns({c: self.scaler.expr(c) for c in self.spec.dense})

    def fcol(self, c: str):
        """Model input for feature ``c`` (standardised when dense)."""
        if self.standardize and self.scaler and c in self.scaler.mean:
            return self.scaler.expr(c)
        return F.col(c).cast("double")

    def _check(self):
        if not self.is_trained:
            raise RuntimeError(f"{self.name}: call fit before scoring")

    # -- persistence (S-08) ---------------------------------------------
    def state(self) -> dict:
        """Fitted state beside the shared fields, as JSON values."""
        return {}

    def restore(self, state: dict) -> None:
        """Inverse of ``state``."""

    def save_parts(self, path: str) -> None:
        """Write what is not JSON below ``path``."""

    def load_parts(self, spark, path: str) -> None:
        """Inverse of ``save_parts``."""

    # -- contract -------------------------------------------------------
    def fit(self, train: DataFrame) -> "Recommender":
        raise NotImplementedError

    def proba(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def topk(self, df: DataFrame) -> DataFrame:
        return topk_long(self.proba(df), self.k, self.spec.row_id)

    def recommend(self, df: DataFrame) -> DataFrame:
        return recommend_wide(self.proba(df), self.k, self.spec.row_id)

    def score(self, df: DataFrame, methods=("auc", "logloss", "hr_k", "ndcg_k")) -> DataFrame:
        """Metrics of one scoring pass: row metrics and the per-class ranking
        both read the staged (label, probabilities)."""
        scored = stage(self.proba(df).select(self.spec.item, "proba"), "scores")
        return score_all(scored, self.k, methods, self.spec.item)
