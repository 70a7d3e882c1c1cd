"""M-04 KNN recommender and I-05 KNN imputer on the exact tiled neighbour
search of ``operators.neighbors``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.clean import round_half_even
from lacuna.models.base import Recommender
from lacuna.operators.neighbors import knn_candidates
from lacuna.operators.ranking import proba_wide


class KNNRecommender(Recommender):
    """k = 10, weights = 1/distance (a zero distance takes all the weight),
    Euclidean over the standardised user vector."""
    name = "KNN"

    def fit(self, train: DataFrame) -> "KNNRecommender":
        self._prep_fit(train)
        self.k_neighbors = int(self.params.get("n_neighbors", 10))
        self.train = train
        self.found = None
        self.is_trained = True
        return self

    def narrowed(self, found: DataFrame) -> "KNNRecommender":
        """Takes its neighbours from ``found``, a search over the same train rows
        and the rows to score with at least as many neighbours."""
        self.found = found
        return self

    def state(self) -> dict:
        return {"neighbors": self.k_neighbors}

    def restore(self, state: dict) -> None:
        self.k_neighbors, self.found = state["neighbors"], None

    def save_parts(self, path: str) -> None:
        self.train.write.mode("overwrite").parquet(f"{path}/donors")

    def load_parts(self, spark, path: str) -> None:
        self.train = spark.read.parquet(f"{path}/donors")

    def _zcols(self, df):
        return df.select(self.spec.row_id, *[self.fcol(c).alias(c) for c in self.spec.features])

    def neighbours(self, df: DataFrame) -> DataFrame:
        if self.found is not None:
            return self.found.where(F.col("rank") <= self.k_neighbors)
        q = self._zcols(df)
        d = self._zcols(self.train)
        return knn_candidates(q, d, self.spec.row_id, self.spec.row_id, self.spec.features, self.k_neighbors)

    def proba(self, df: DataFrame) -> DataFrame:
        self._check()
        rid, item = self.spec.row_id, self.spec.item
        nb = self.neighbours(df)
        labels = self.train.select(F.col(rid).alias("donor"), F.col(item).alias("_y"))
        nb = nb.join(labels, "donor")
        has_zero = F.max((F.col("d2") == 0).cast("int")).over(Window.partitionBy(rid))
        w = F.when(has_zero == 1, (F.col("d2") == 0).cast("double")).otherwise(F.lit(1.0) / F.sqrt("d2"))
        votes = nb.withColumn("_w", w).groupBy(rid, F.col("_y").alias("class_id")).agg(F.sum("_w").alias("_s"))
        tot = F.sum("_s").over(Window.partitionBy(rid))
        long = votes.select(rid, "class_id", (F.col("_s") / tot).alias("proba"))
        wide = proba_wide(long, self.n_classes, rid)
        return df.join(wide, rid, "left")


class KNNImputer:
    """I-05: mean of the 5 nearest train donors that have the column
    (nan-Euclidean distance); no donor -> train column mean."""

    def __init__(self, cols: list[str], k: int = 5, row_id: str = "row_id", codes: tuple = ()):
        self.cols, self.k, self.row_id, self.codes = list(cols), k, row_id, codes

    def fit(self, train: DataFrame) -> "KNNImputer":
        self.train = train.select(self.row_id, *self.cols)
        r = train.agg(*[F.avg(c).alias(c) for c in self.cols]).first()
        self.means = {c: float(r[c]) if r[c] is not None else 0.0 for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rid = self.row_id
        miss = None
        for c in self.cols:
            m = F.col(c).isNull()
            miss = m if miss is None else miss | m
        need = df.where(miss).select(rid, *self.cols)
        cand = knn_candidates(need, self.train, rid, rid, self.cols, self.k, nan_euclidean=True,
                              donor_values=self.cols)
        fill = cand.groupBy(rid).pivot("col", self.cols).agg(F.avg("value"))
        fill = fill.select(rid, *[F.col(c).alias(f"_f_{c}") for c in self.cols])
        out = df.join(fill, rid, "left")

        def value(c):
            v = F.coalesce(F.col(c).cast("double"), F.col(f"_f_{c}"), F.lit(self.means[c]))
            return round_half_even(v).cast("double") if c in self.codes else v

        return out.select(*[value(c).alias(c) if c in self.cols else F.col(c) for c in df.columns])
