"""Stateless scoring of a streaming DataFrame.

Cleaning expressions, fitted scalers and the NB/KNN-free recommenders'
``proba`` are row-wise, so a model fitted on a batch table scores a
``readStream`` source unchanged; top-k is an array sort per row.  Nothing
here keeps state across micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lacuna.operators.ranking import topk_long


def score_stream(model, stream: DataFrame, k: int | None = None) -> DataFrame:
    """Attach ``proba`` (and optionally explode the top-k) to a stream."""
    p = model.proba(stream)
    return topk_long(p, k, model.spec.row_id) if k else p
