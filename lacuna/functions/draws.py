"""N-01: keyed deterministic draws.

``u(seed, salt, key)`` is a uniform double in [0, 1) computed from the md5 of
``seed|salt|key``: the first 13 hex digits (52 bits) divided by 2^52.  It
depends only on the row key, never on partitioning or execution order, so a
re-run after executor loss gives the same value.  The same number comes out
of DuckDB (``sql_uniform``), which is what the oracle checks rely on.

``bucket`` (first 4 hex digits) is ``floor(u * 65536)``, a uniform hash bucket
monotone in ``u`` used by the distributed rank (operators.rank).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = float(2 ** 52)
N_BUCKETS = 65536


def _key(seed, salt, key) -> Column:
    key_col = key if isinstance(key, Column) else F.col(key)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), salt if isinstance(salt, Column) else F.lit(str(salt)), key_col.cast("string")))


def uniform(seed, salt, key) -> Column:
    """U[0,1) keyed by (seed, salt, key)."""
    h = F.substring(_key(seed, salt, key), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(TWO52)


def bucket_of(u: Column) -> Column:
    """Hash bucket monotone in u: floor(u * 65536) as int."""
    return F.floor(u * F.lit(float(N_BUCKETS))).cast("int")


def normal(seed, salt, key) -> Column:
    """Standard normal by Box-Muller on two salts (u1 shifted off zero)."""
    u1 = uniform(seed, f"{salt}#n1", key)
    u2 = uniform(seed, f"{salt}#n2", key)
    r = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1))
    return r * F.cos(F.lit(2.0 * math.pi) * u2)


def key_bytes(keys: list) -> list:
    """Row ids as bytes (None where null), as ``uniforms`` takes them: a null id
    leaves no part in the key."""
    return [b"" if k is None else b"|" + k for k in keys]


def uniforms(seed, salt, keys: list) -> np.ndarray:
    """``uniform`` of each key of ``key_bytes``, in a task."""
    start, out = hashlib.md5(f"{seed}|{salt}".encode()), []
    for key in keys:
        h = start.copy()
        h.update(key)
        out.append(h.digest())
    # the first 13 hex digits are the upper 52 of 64 bits
    return (np.frombuffer(b"".join(out), ">u8")[::2] >> np.uint64(12)).astype(np.float64) / TWO52


# ---- DuckDB text of the same draws (oracle side) -------------------------

def sql_uniform(seed, salt, key_sql: str) -> str:
    return (f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', CAST({key_sql} AS VARCHAR))), 1, 13))"
            f"::BIGINT / 4503599627370496.0)")


def sql_normal(seed, salt, key_sql: str) -> str:
    u1 = sql_uniform(seed, f"{salt}#n1", key_sql)
    u2 = sql_uniform(seed, f"{salt}#n2", key_sql)
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos({2.0 * math.pi!r} * {u2}))"
