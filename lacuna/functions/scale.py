"""F-04..F-09, F-11: fitted column transforms.

Fitting is one ``agg`` (a handful of scalars per column, collected to the
driver: bounded by the column count); applying is a plain column expression
with literals, so it stays inside whole-stage codegen and works on streaming
DataFrames too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class ZScore:
    """F-04/F-05: population standard deviation; zero (or undefined) std -> 1."""
    mean: dict = field(default_factory=dict)
    std: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str]) -> "ZScore":
        if not cols:
            return cls()
        aggs = []
        for c in cols:
            aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
        r = df.agg(*aggs).first()
        mean = {c: (r[f"m_{c}"] if r[f"m_{c}"] is not None else 0.0) for c in cols}
        std = {c: (r[f"s_{c}"] if r[f"s_{c}"] not in (None, 0.0) else 1.0) for c in cols}
        return cls(mean, std)

    def expr(self, c: str, value: Column | None = None) -> Column:
        v = F.col(c) if value is None else value
        return (v - F.lit(self.mean[c])) / F.lit(self.std[c])

    def inverse(self, c: str, value: Column) -> Column:
        return value * F.lit(self.std[c]) + F.lit(self.mean[c])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expr(c) for c in self.mean})


@dataclass
class MinMax:
    """F-06: min-max scale to [0,1]; fitted with nulls read as 0 (GAIN)."""
    lo: dict = field(default_factory=dict)
    hi: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], null_as_zero: bool = True) -> "MinMax":
        v = (lambda c: F.coalesce(F.col(c), F.lit(0.0))) if null_as_zero else F.col
        aggs = []
        for c in cols:
            aggs += [F.min(v(c)).alias(f"lo_{c}"), F.max(v(c)).alias(f"hi_{c}")]
        r = df.agg(*aggs).first()
        return cls({c: float(r[f"lo_{c}"]) for c in cols}, {c: float(r[f"hi_{c}"]) for c in cols})

    def expr(self, c: str, value: Column | None = None) -> Column:
        v = F.col(c) if value is None else value
        rng = self.hi[c] - self.lo[c]
        return (v - F.lit(self.lo[c])) / F.lit(rng if rng != 0 else 1.0)

    def inverse(self, c: str, value: Column) -> Column:
        rng = self.hi[c] - self.lo[c]
        return value * F.lit(rng if rng != 0 else 1.0) + F.lit(self.lo[c])


@dataclass
class MeanFillScale:
    """F-07: mean-fill then z-score; a missing cell becomes 0.  The deviation
    is that of the filled column: over all rows, missing ones at the mean."""
    z: ZScore

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str]) -> "MeanFillScale":
        if not cols:
            return cls(ZScore())
        # squares about the mean of the observed cells, over all rows
        aggs = [F.count(F.lit(1)).alias("n")]
        for c in cols:
            aggs += [F.avg(c).alias(f"m_{c}"), (F.var_pop(c) * F.count(c)).alias(f"s_{c}")]
        r = df.agg(*aggs).first()
        std = {c: ((r[f"s_{c}"] or 0.0) / max(r["n"], 1)) ** 0.5 for c in cols}
        return cls(ZScore({c: r[f"m_{c}"] if r[f"m_{c}"] is not None else 0.0 for c in cols},
                          {c: v if v > 0 else 1.0 for c, v in std.items()}))

    def expr(self, c: str) -> Column:
        return F.coalesce(self.z.expr(c), F.lit(0.0))

    def inverse(self, c: str, value: Column) -> Column:
        return self.z.inverse(c, value)


def missing_mask(cols: list[str]) -> Column:
    """F-08: 1 = observed, 0 = missing, as an int array in column order."""
    return F.array(*[F.col(c).isNotNull().cast("int") for c in cols])


@dataclass
class UniformBins:
    """F-09: equal-width bins over the train range; bin = least(b-1,
    floor((x-min)/(max-min)*b)), clipped at 0."""
    lo: dict
    hi: dict
    bins: int = 5

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], bins: int = 5) -> "UniformBins":
        m = MinMax.fit(df, cols, null_as_zero=False)
        return cls(m.lo, m.hi, bins)

    def expr(self, c: str) -> Column:
        rng = self.hi[c] - self.lo[c]
        raw = F.floor((F.col(c) - F.lit(self.lo[c])) / F.lit(rng if rng != 0 else 1.0) * F.lit(self.bins))
        return F.greatest(F.lit(0), F.least(F.lit(self.bins - 1), raw)).cast("long")


def assemble(cols: list[str]) -> Column:
    """F-11: user vector sparse ++ dense as array<double>."""
    return F.array(*[F.col(c).cast("double") for c in cols])
