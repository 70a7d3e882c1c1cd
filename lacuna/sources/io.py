"""S-06 / S-07 sinks: parquet tables and the experiment result log.

The result log is one table partitioned by ``experiment``; writing an
experiment replaces only its own partition (dynamic partition overwrite),
which is the "replace this sheet" behaviour of the reference's workbook.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_results(df: DataFrame, path: str, partition: str = "experiment") -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
