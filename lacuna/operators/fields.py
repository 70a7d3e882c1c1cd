"""F-12: field embedding look-up.

A table (field, code, vector) is applied to all sparse columns in one join over
(field, code): the row is taken apart into one entry a field, and put together
again by row id.  A code that many rows hold is a hot key of that join, so its
rows are dealt to as many salts as it holds ``hot_rows``, and its vector is
copied to each.  Numeric fields are ``w x + b`` with one (w, b) a component.

Null codes and codes without a vector give zeros; a null number gives b.  Row
ids are unique; other columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import stage, unstage

#: At most so many codes are split, so that their table is small enough to broadcast.
HOT_CODES = 4096


def hot_codes(entries: DataFrame, hot_rows: int) -> DataFrame:
    """(field, code, splits) of the codes with more than ``hot_rows`` entries
    (or than a 4096th of all, where that is more)."""
    counts = stage(entries.groupBy("field", "code").agg(F.count(F.lit(1)).alias("n")), "codes")
    total = counts.agg(F.sum("n")).first()[0] or 0
    bar = max(int(hot_rows), total // HOT_CODES)
    hot = stage(counts.where(F.col("n") > bar).select("field", "code", F.ceil(F.col("n") / F.lit(bar)).cast("int").alias("splits")), "hot")
    unstage(counts)
    return hot


def field_embed(df: DataFrame, table: DataFrame, sparse, dense, weights: dict, dim: int, row_id: str = "row_id",
                out: str = "fields", hot_rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``out``: the vectors of ``sparse``, then those of ``dense``,
    one after the other in an array<double>.  ``weights[c]`` is (w, b), two
    lists of ``dim`` numbers."""
    zeros = F.array(*[F.lit(0.0)] * dim)
    numeric = [F.coalesce(F.lit(float(w)) * F.col(c).cast("double"), F.lit(0.0)) + F.lit(float(b))
               for c in dense for w, b in zip(*weights[c])]
    tail = F.array(*numeric) if numeric else F.array().cast("array<double>")
    if not sparse:
        return df.withColumn(out, tail)
    entries = df.select(F.col(row_id).alias("_row"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("pos"), F.lit(c).alias("field"), F.col(c).cast("long").alias("code"))
        for k, c in enumerate(sparse)])).alias("e")).select("_row", "e.*")
    hot = F.broadcast(hot_codes(entries.where("code IS NOT NULL"), hot_rows))
    salted = (entries.join(hot, ["field", "code"], "left")
              .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("splits")), F.lit(0)).cast("int")).drop("splits"))
    copies = (table.select("field", F.col("code").cast("long").alias("code"), F.col("vector").cast("array<double>").alias("vector"))
              .join(hot, ["field", "code"], "left")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("splits") - 1, F.lit(0))))).drop("splits"))
    found = salted.join(copies, ["field", "code", "salt"], "left").select("_row", F.struct("pos", F.coalesce("vector", zeros).alias("v")).alias("e"))
    # at most one entry a field in each group
    wide = found.groupBy("_row").agg(F.sort_array(F.collect_list("e")).alias("_e"))
    wide = wide.select("_row", F.flatten(F.transform("_e", lambda e: e["v"])).alias("_sparse"))
    return (df.join(wide, F.col(row_id) == F.col("_row"), "left").withColumn(out, F.concat("_sparse", tail)).drop("_row", "_sparse"))
