"""Recommenders by name, and models on disk (S-08)."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from lacuna.models.base import Recommender
from lacuna.models.bayes import BayesNetRecommender
from lacuna.models.ensemble import Augment, Ensemble
from lacuna.models.knn import KNNRecommender
from lacuna.models.linear import LogisticRecommender
from lacuna.models.nb import GaussianNB
from lacuna.models.trees import CatBoostStyle, ForestRecommender, LightGBMStyle, XGBoostStyle
from lacuna.spec import FeatureSpec, check_choice

MODELS = {c.name: c for c in (GaussianNB, KNNRecommender, LogisticRecommender, ForestRecommender, XGBoostStyle,
                              LightGBMStyle, CatBoostStyle, BayesNetRecommender, Ensemble, Augment)}


def recommender(name: str, spec: FeatureSpec, **params) -> Recommender:
    """An unfitted recommender by name; unknown names raise."""
    check_choice("model", name, MODELS)
    return MODELS[name](spec, **params)


def save_model(model: Recommender, spark: SparkSession, path: str) -> None:
    """The fitted state as one JSON row below ``path``, beside the Spark ML
    model or the donor table where the recommender has one."""
    state = dict(model.state(), name=model.name, k=model.k, seed=model.seed, standardize=model.standardize,
                 params=model.params, n_classes=model.n_classes,
                 scaler=[model.scaler.mean, model.scaler.std] if model.scaler else None,
                 spec=[model.spec.item, model.spec.sparse, model.spec.dense, model.spec.row_id])
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
    model.save_parts(path)


def load_model(spark: SparkSession, path: str) -> Recommender:
    """A model written by ``save_model``, ready to score."""
    from lacuna.functions.scale import ZScore
    state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
    item, sparse, dense, row_id = state["spec"]
    model = recommender(state["name"], FeatureSpec(item, tuple(sparse), tuple(dense), row_id), k=state["k"],
                        seed=state["seed"], standardize=state["standardize"], **state["params"])
    model.n_classes = state["n_classes"]
    model.scaler = ZScore(*state["scaler"]) if state["scaler"] else None
    model.restore(state)
    model.load_parts(spark, path)
    model.is_trained = True
    return model
