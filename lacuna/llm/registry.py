"""Registry of the subpackage's queries and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
