"""A raw, dirty quotes table derived row-for-row from orders x customer x
nation (FIXTURES.md §1 asks for the reference's dirty values; they are
planted into real rows by keyed draws so the work grows with the tables).

Two "source files" are produced (orders with status F, and the rest) under
the two column-name sets of the reference's raw workbooks, so the scan /
rename / union steps have something to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.draws import sql_uniform, uniform
from lacuna.operators.rank import join_small
from lacuna.sources.tables import read_table

# ---- fixed values (must equal the reference's cleaning rules) -------------
AGE_MAP = {"70歲以上": "71", "70+": "71"}
DRIVING_EXP_MAP = {"多於 10 年": "11", "暫准駕駛執照 ( P牌 ）": "0", "+10 years": "11",
                   "Option One": None, ">": None}
OCCUPATION_MAP = {"clekr": "文員", "Option One": None}
INVALID_BRANDS = ["---------------", "--------------------", "_______________________", "----------", "nan"]
MAKE_MAP = {"MITSUBISHI FUSO": "MAYBACH"}
CAR_YEAR_MAP = {"1980 或之前": "1980", "VOXY": None, "MODEL S": None}
SOURCE1_COLS = ["Age", "Driving exp", "Occupation", "Coverage", "Insurer", "NCD", "Settlement Date", "Make",
                "Year of manufacturer", "Sum of insured"]
SOURCE2_COLS = ["Age", "DE", "Occupation", "Coverage", "Insur Co", "NCD", "Settlement Date", "Make", "Man. Year",
                "Sum Insured"]
CLEAN_COLS = ["Age", "DrivingExp", "Occupation", "Coverage", "Insurer", "NCD", "Date", "Make", "Car.year",
              "Car.price"]
# ---------------------------------------------------------------------------

# (upper bound of the draw band, value) per raw column; the last band's value
# is an expression over the real row.
_BANDS = {
    "Age": [(0.03, "'70歲以上'"), (0.06, "'70+'"), (0.07, "'nan'"), (0.08, "'10d'"), (0.09, "' 1e2 '"), (None, "CAST(18 + CAST(floor({v} * 50) AS BIGINT) AS STRING)")],
    "DrivingExp": [(0.08, "'多於 10 年'"), (0.10, "'暫准駕駛執照 ( P牌 ）'"), (0.12, "'+10 years'"),
                   (0.13, "'Option One'"), (0.14, "'>'"),
                   (None, "concat(CAST(CAST(floor({v} * 10) AS BIGINT) AS STRING), ' years')")],
    "Occupation": [(0.16, "'clekr'"), (0.17, "'Option One'"),
                   (0.28, "concat(lower(c_mktsegment), ' 文員|', n_name)"), (0.30, "'\u3000文員\u3000'"),
                   (None, "concat('  ', c_mktsegment, ' ')")],
    "Make": [(0.32, "'---------------'"), (0.33, "'nan'"), (0.35, "concat(chr(65279), lower(n_name))"),
             (0.36, "'mitsubishi fuso'"), (None, "concat(' ', n_name, ' ')")],
    "CarYear": [(0.38, "'1980 或之前'"), (0.39, "'VOXY'"), (0.40, "'MODEL S'"), (0.41, "'nan'"),
                (None, "CAST(1985 + CAST(floor({v} * 20) AS BIGINT) AS STRING)")],
}


def _case(bands, u: str, v: str, spark_side: bool) -> str:
    parts = []
    for hi, val in bands:
        val = val.format(v=v)
        if spark_side:
            val = val.replace("chr(65279)", "'\ufeff'")  # Spark's chr() is ASCII-only
        if hi is None:
            parts.append(f"ELSE {val}")
        else:
            parts.append(f"WHEN {u} < {hi} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


def _raw_exprs(u: str, v: str, spark_side: bool) -> dict:
    e = {k: _case(b, u, v, spark_side) for k, b in _BANDS.items()}
    e["Insurer"] = f"CASE WHEN {u} >= 0.40 AND {u} < 0.43 THEN NULL ELSE o_orderpriority END"
    e["Coverage"] = f"CASE WHEN {u} >= 0.41 AND {u} < 0.45 THEN NULL ELSE o_orderstatus END"
    e["NCD"] = "CAST(CAST(c_nationkey % 6 AS BIGINT) * 10 AS STRING)"
    e["Date"] = "CAST(o_orderdate AS DATE)"
    e["Price"] = "o_totalprice"
    return e


_RAW_ORDER = ["Age", "DrivingExp", "Occupation", "Coverage", "Insurer", "NCD", "Date", "Make", "CarYear", "Price"]


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean column names, raw dirty values; ``row_id`` = o_orderkey."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                             "o_orderdate", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    j = o.join(c, o.o_custkey == c.c_custkey)
    j = join_small(j, n, j.c_nationkey == n.n_nationkey)
    j = j.withColumn("_u", uniform(11, "raw", "o_orderkey")).withColumn("_v", uniform(11, "raw2", "o_orderkey"))
    ex = _raw_exprs("_u", "_v", True)
    return j.select(F.col("o_orderkey").alias("row_id"), *[F.expr(ex[k]).alias(k) for k in _RAW_ORDER])


def raw_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two raw "files": status F under source-1 names, the rest under
    source-2 names (each keeps ``row_id``)."""
    r = raw_quotes(spark, sf_dir)
    a = r.where(F.col("Coverage") == "F")
    b = r.where(F.col("Coverage").isNull() | (F.col("Coverage") != "F"))
    return (a.select("row_id", *[F.col(k).alias(n) for k, n in zip(_RAW_ORDER, SOURCE1_COLS)]),
            b.select("row_id", *[F.col(k).alias(n) for k, n in zip(_RAW_ORDER, SOURCE2_COLS)]))


RAW_SQL = (
    "raw_j AS (SELECT o.*, c.c_nationkey, c.c_mktsegment, n.n_name, "
    + sql_uniform(11, "raw", "o.o_orderkey") + " AS _u, " + sql_uniform(11, "raw2", "o.o_orderkey") + " AS _v "
    "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),\n"
    "raw AS (SELECT o_orderkey AS row_id, "
    + ", ".join(f'{_raw_exprs("_u", "_v", False)[k]} AS "{k}"' for k in _RAW_ORDER)
    + " FROM raw_j)"
)
