"""S-01..S-03: scans of the given parquet tables and column-pruned, renamed
reads.  Only the requested columns are selected so Catalyst prunes the
parquet ``ReadSchema``; NaN is normalised to NULL at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN sorts above every value in Spark aggregates; missing is NULL here."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(F.isnan(F.col(f.name)), None).otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def scan_renamed(spark: SparkSession, path: str, mapping: dict[str, str], fmt: str = "parquet",
                 schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """S-02/S-03: read only ``mapping``'s source columns and rename them
    (old -> new), in mapping order."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", str(header).lower())
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """U-01/U-02: union all by column name; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
