"""I-10 / I-12: fit-on-train, apply-anywhere imputers (simple ones).

The chained and neighbour imputers live in ``lacuna.operators.mice`` and ``lacuna.models.knn``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.clean import round_half_even


@dataclass
class MeanImputer:
    """I-12: NULL -> train column mean; ``codes`` are rounded half to even."""
    cols: list
    means: dict = field(default_factory=dict)
    codes: tuple = ()

    def fit(self, df: DataFrame) -> "MeanImputer":
        r = df.agg(*[F.avg(c).alias(c) for c in self.cols]).first()
        self.means = {c: (float(r[c]) if r[c] is not None else 0.0) for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, m in self.means.items():
            v = F.coalesce(F.col(c).cast("double"), F.lit(m))
            out[c] = round_half_even(v).cast("double") if c in self.codes else v
        return df.withColumns(out)
