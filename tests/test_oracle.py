"""Every registered query with an oracle matches DuckDB on sf0.001
(row count, column names, order-insensitive rounded values)."""

import math
from collections import Counter

import pytest

import __spark_entry__ as E

from main_data import SF_SMALL

SQL = E.oracle_sql()
FAST = sorted(SQL)


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = [dcols.index(c) for c in sdf.columns]
    drows = [tuple(norm(r[i]) for i in order) for r in res.fetchall()]
    assert Counter(srows) == Counter(drows)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and 0.0 <= rows[0]["hr_k"] <= 1.0
