"""F-01..F-03: sorted factorisation and vocabularies.

A dictionary is the sorted distinct non-null values of a column mapped to
consecutive codes.  Fitting is one ``distinct`` (partial aggregation) and
distributed positions over the distinct set, staged as a (value, code) table.
Applying it is a left join, which adaptive execution broadcasts if the table's
measured bytes allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.rank import dense_codes
from lacuna.session import stage


@dataclass
class Dictionary:
    column: str
    table: DataFrame   # (_v, _idx)

    @classmethod
    def fit(cls, df: DataFrame, column: str, start: int = 0, value: Column | None = None) -> "Dictionary":
        v = value if value is not None else F.col(column)
        vals = df.select(v.alias("_v")).where(F.col("_v").isNotNull()).distinct()
        return cls(column, stage(dense_codes(vals, "_v", "_idx", start), "dictionary"))

    def apply(self, df: DataFrame, out: str | None = None, default: int | None = -1,
              value: Column | None = None) -> DataFrame:
        v = value if value is not None else F.col(self.column)
        joined = df.withColumn("_v", v).join(self.table, "_v", "left")
        code = F.col("_idx") if default is None else F.coalesce(F.col("_idx"), F.lit(default))
        return joined.withColumn(out or self.column, code.cast("long")).drop("_v", "_idx")


def factorize(df: DataFrame, column: str, out: str | None = None, null_code: int | None = -1,
              value: Column | None = None) -> DataFrame:
    """F-01: sorted distinct -> 0..K-1; null -> ``null_code`` (-1, or None to
    keep NULL)."""
    d = Dictionary.fit(df, column, 0, value)
    return d.apply(df, out or column, null_code, value)


def fit_vocabulary(df: DataFrame, column: str) -> Dictionary:
    """F-02: sorted distinct -> 1..n (0 is reserved for null/unseen)."""
    return Dictionary.fit(df, column, start=1)


def apply_vocabulary(df: DataFrame, vocab: Dictionary, out: str | None = None) -> DataFrame:
    """F-03: unseen and null -> 0."""
    return vocab.apply(df, out or vocab.column, default=0)
