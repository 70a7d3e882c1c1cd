"""Rows of a table that are left after a dedup named the losers by id and
text digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivors(flat: DataFrame, own_id: Column, digest: Column, dropped: DataFrame, many: DataFrame) -> DataFrame:
    """``flat`` without the rows named in ``dropped`` (drop_id, drop_digest),
    and with one row for each of ``many``, which name several rows: the one
    with the least hash over all columns.  Null ids are ids of their own."""
    match = own_id.eqNullSafe(F.col("drop_id")) & (digest == F.col("drop_digest"))
    rest = flat.join(dropped.unionByName(many), match, "left_anti")
    whole = F.struct(*flat.columns)
    picked = (flat.join(many, match).groupBy("drop_id", "drop_digest")
              .agg(F.min_by(whole, F.xxhash64(*flat.columns)).alias("whole")).select("whole.*"))
    return rest.unionByName(picked)
