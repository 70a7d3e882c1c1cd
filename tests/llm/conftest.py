import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(os.path.dirname(HERE)), HERE]

from llm_data import DOCS, SF, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from lacuna.session import get_session
    return get_session(master="local[*]", partitions=4, app="lacuna-llm-tests")


@pytest.fixture(scope="session")
def tables():
    """Rows of the small tables, read without the library."""
    import duckdb
    con = duckdb.connect()

    def rows(name):
        return con.execute(f"SELECT * FROM read_parquet('{SF}/{name}.parquet')").fetchall()
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with further columns named like the operators' own."""
    from pyspark.sql import functions as F
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(
        ["id", "key", "digest", "node", "kept", "score", "spans", "n", "c0", "c1", "drop_id", "_id", "same"])])
