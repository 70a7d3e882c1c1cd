"""Scans, renames, unions and cleaning scalars (S-01..S-03, U-01, U-03,
P-01..P-18) over the dirty quotes derived from orders x customer x nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import clean as C
from lacuna.operators.prepare import prepare_quotes
from lacuna.plans.registry import query, sql_in, sql_map
from lacuna.sources.fixtures import with_sql
from lacuna.sources.raw import (AGE_MAP, CAR_YEAR_MAP, DRIVING_EXP_MAP, INVALID_BRANDS, MAKE_MAP, OCCUPATION_MAP,
                                RAW_SQL, SOURCE1_COLS, SOURCE2_COLS, raw_quotes, raw_sources)
from lacuna.sources.tables import read_table, scan_renamed, table_path, union_sources

# Unicode white space, spelled out (the engine's own class is ASCII only)
_WHITE = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
TRIM = "regexp_replace({x}, '^[" + _WHITE.replace("{", "{{").replace("}", "}}") + "]+|[" + _WHITE.replace("{", "{{").replace(
    "}", "}}") + "]+$', '', 'g')"
_NUMERAL = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def _number(x: str) -> str:
    """Numerals as double, all else NULL ('nan' and '10d' count as missing)."""
    return f"(CASE WHEN regexp_full_match({_trim(x)}, '{_NUMERAL}') THEN TRY_CAST({_trim(x)} AS DOUBLE) END)"


def _trim(x: str) -> str:
    return TRIM.format(x=x)


def _make_sql(x: str) -> str:
    up = f"upper(replace({_trim(x)}, chr(65279), ''))"
    tok = f"(CASE WHEN {up} IN {sql_in(INVALID_BRANDS)} THEN NULL ELSE {up} END)"
    return sql_map(tok, MAKE_MAP)


def _occ_sql(x: str) -> str:
    cut = f"regexp_replace(regexp_replace({x}, '\\|.*', ''), '.*? ([一-龥].*)', '\\1')"
    return _trim(sql_map(cut, OCCUPATION_MAP))


def _caryear_sql(x: str, date: str) -> str:
    v = _number(sql_map(_trim(x), CAR_YEAR_MAP))
    return f"(CASE WHEN year({date}) - {v} >= 0 THEN year({date}) - {v} END)"


@query("scan_prune_rename", with_sql(RAW_SQL) + """
SELECT row_id, "Age", "DrivingExp" AS "Driving exp", "Insurer", "CarYear" AS "Year of manufacturer" FROM raw""")
def q_scan_prune_rename(spark, sf):
    """S-01..S-03: only the listed columns of both sources, under the names
    of the first."""
    a, b = raw_sources(spark, sf)
    names = {"row_id": "row_id", "Age": "Age", "DE": "Driving exp", "Insur Co": "Insurer", "Man. Year": "Year of manufacturer"}
    return union_sources([a.select("row_id", "Age", "`Driving exp`", "Insurer", "`Year of manufacturer`"),
                          b.select(*[F.col(f"`{o}`").alias(n) for o, n in names.items()])])


@query("union_sources", with_sql(RAW_SQL) + """
SELECT row_id, "Age", "DrivingExp", "Insurer", "Coverage" FROM raw""")
def q_union_sources(spark, sf):
    """U-01: two renamed sources unioned by name."""
    a, b = raw_sources(spark, sf)
    a = a.select("row_id", "Age", F.col("`Driving exp`").alias("DrivingExp"), "Insurer", "Coverage")
    b = b.select("row_id", "Age", F.col("DE").alias("DrivingExp"), F.col("`Insur Co`").alias("Insurer"), "Coverage")
    return union_sources([a, b])


@query("clean_scalars", with_sql(RAW_SQL) + f"""
SELECT row_id,
  {_number(sql_map('"Age"', AGE_MAP))} AS age,
  TRY_CAST(regexp_replace({sql_map('"DrivingExp"', DRIVING_EXP_MAP)}, '[^0-9]', '', 'g') AS DOUBLE) AS drive_exp,
  {_make_sql('"Make"')} AS make,
  {_caryear_sql('"CarYear"', '"Date"')} AS car_age
FROM raw""")
def q_clean_scalars(spark, sf):
    """P-05, P-06, P-07, P-08, P-11, P-12, P-16, P-17."""
    r = raw_quotes(spark, sf)
    year = C.to_number(C.replace_values(C.trim_ws("CarYear"), CAR_YEAR_MAP))
    return r.select(
        "row_id",
        C.to_number(C.replace_values("Age", AGE_MAP)).alias("age"),
        C.to_number(C.strip_non_digits(C.replace_values("DrivingExp", DRIVING_EXP_MAP))).alias("drive_exp"),
        C.replace_values(C.tokens_to_null(C.unbom_upper(C.trim_ws("Make")), INVALID_BRANDS), MAKE_MAP).alias("make"),
        C.null_if_negative(C.age_from("Date", year)).alias("car_age"))


@query("clean_regex", with_sql(RAW_SQL) + f"""
SELECT row_id, {_occ_sql('"Occupation"')} AS occupation,
       regexp_replace("DrivingExp", '[^0-9]', '', 'g') AS digits,
       regexp_replace("Occupation", '\\|.*', '') AS cut
FROM raw""")
def q_clean_regex(spark, sf):
    """P-08, P-09, P-10, P-11 (+ P-05 on the result)."""
    r = raw_quotes(spark, sf)
    occ = C.trim_ws(C.replace_values(C.keep_cjk_tail(C.cut_after("Occupation")), OCCUPATION_MAP))
    return r.select("row_id", occ.alias("occupation"), C.strip_non_digits("DrivingExp").alias("digits"),
                    C.cut_after("Occupation").alias("cut"))


@query("composite_key_filled", with_sql(RAW_SQL) + """
SELECT row_id, CASE WHEN "Insurer" IS NULL AND "Coverage" IS NULL THEN NULL
  ELSE concat_ws('|', coalesce("Insurer", 'Missing'), coalesce("Coverage", 'Missing')) END AS product_key
FROM raw""")
def q_composite_filled(spark, sf):
    """P-13."""
    return raw_quotes(spark, sf).select("row_id", C.composite_filled("Insurer", "Coverage").alias("product_key"))


@query("composite_key_nullprop", with_sql(RAW_SQL) + """
SELECT row_id, "Insurer" || "Coverage" || "NCD" AS product_key FROM raw""")
def q_composite_nullprop(spark, sf):
    """P-14: NULL when any part is NULL."""
    return raw_quotes(spark, sf).select("row_id", C.composite_nullprop("Insurer", "Coverage", "NCD")
                                        .alias("product_key"))


@query("date_age", with_sql(RAW_SQL) + f"""
, d AS (SELECT row_id, upper(strftime("Date", '%d-%b-%y')) AS ds, "CarYear" FROM raw)
SELECT row_id, ds, CAST(strptime(ds, '%d-%b-%y') AS DATE) AS d,
       year(CAST(strptime(ds, '%d-%b-%y') AS DATE)) - {_number(sql_map(_trim('"CarYear"'), CAR_YEAR_MAP))}
         AS age
FROM d""")
def q_date_age(spark, sf):
    """P-15 (dd-MMM-yy, upper-case month, 2-digit-year pivot) and P-16."""
    r = raw_quotes(spark, sf).select("row_id", F.upper(F.date_format("Date", "dd-MMM-yy")).alias("ds"), "CarYear")
    d = C.parse_dd_mon_yy("ds")
    year = C.to_number(C.replace_values(C.trim_ws("CarYear"), CAR_YEAR_MAP))
    return r.select("row_id", "ds", d.alias("d"), C.age_from(d, year).alias("age"))


def _factor_sql(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN NULL ELSE CAST(dense_rank() OVER "
            f"(PARTITION BY {col} IS NULL ORDER BY {col}) - 1 AS BIGINT) END")


PREPARE_SQL = with_sql(RAW_SQL) + f""",
u AS (SELECT row_id, "Age", "DrivingExp", "Occupation", "Coverage", "Insurer", "NCD", "Date", "Make",
             "CarYear" AS "Car.year", "Price" AS "Car.price" FROM raw WHERE "Insurer" IS NOT NULL),
dd AS (SELECT min(row_id) AS row_id, "Age", "DrivingExp", "Occupation", "Coverage", "Insurer", "NCD", "Date",
              "Make", "Car.year", "Car.price" FROM u
       GROUP BY "Age", "DrivingExp", "Occupation", "Coverage", "Insurer", "NCD", "Date", "Make", "Car.year",
                "Car.price"),
c1 AS (SELECT row_id,
         {_number(sql_map('"Age"', AGE_MAP))} AS "Age",
         TRY_CAST(regexp_replace({sql_map('"DrivingExp"', DRIVING_EXP_MAP)}, '[^0-9]', '', 'g') AS DOUBLE)
           AS "DrivingExp",
         {_occ_sql('"Occupation"')} AS occ, "Coverage", "Insurer", "NCD", "Date", "Make", "Car.year", "Car.price"
       FROM dd),
c2 AS (SELECT *, {_factor_sql('occ')} AS "Occupation",
         CASE WHEN "Insurer" IS NULL AND "Coverage" IS NULL THEN NULL
           ELSE concat_ws('|', coalesce("Insurer", 'Missing'), coalesce("Coverage", 'Missing')) END AS pk
       FROM c1),
c3 AS (SELECT *, CAST(dense_rank() OVER (ORDER BY pk) - 1 AS BIGINT) AS product_item,
         TRY_CAST("NCD" AS DOUBLE) AS ncd_n, {_make_sql('"Make"')} AS mk
       FROM c2 WHERE pk IN (SELECT pk FROM c2 WHERE pk IS NOT NULL GROUP BY pk HAVING count(*) >= 2))
SELECT row_id, "Age", "DrivingExp", "Occupation", {_factor_sql('ncd_n')} AS "NCD", {_factor_sql('mk')} AS "Make",
       {_caryear_sql('"Car.year"', '"Date"')} AS "Car.year", "Car.price", product_item
FROM c3"""


@query("prepare_quotes", PREPARE_SQL)
def q_prepare(spark, sf):
    """E3 end to end: P-01..P-18, F-01, T-02 (>= 2), U-01, U-03."""
    a, b = raw_sources(spark, sf)
    return prepare_quotes(a, b, SOURCE1_COLS, SOURCE2_COLS)


@query("sort_by_date", """
SELECT o_orderkey AS row_id, CAST(o_orderdate AS DATE) AS d,
       CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS pos
FROM orders""")
def q_sort_by_date(spark, sf):
    """U-03: the sort order becomes an explicit position (Spark keeps no
    row order); ranks by range partitioning, no single-task sort."""
    from lacuna.operators.rank import ordered_positions
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    return ordered_positions(o, ["o_orderdate", "o_orderkey"], "pos").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").cast("date").alias("d"), "pos")


@query("csv_roundtrip", with_sql(RAW_SQL) + """
SELECT row_id, "Age", "Make" FROM raw""")
def q_csv_roundtrip(spark, sf):
    """S-02: write the raw quotes as CSV to the shared folder and read
    back only two columns with an explicit schema (no inference)."""
    import uuid
    from lacuna.session import shared_folder
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    (raw_quotes(spark, sf).select("row_id", "Age", "Make").write.option("header", "true")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    return scan_renamed(spark, path, {"row_id": "row_id", "Age": "Age", "Make": "Make"}, fmt="csv",
                        schema="row_id BIGINT, Age STRING, Make STRING")


def _code_sql(col: str) -> str:
    """Sorted codes with missing values as -1."""
    return (f"CASE WHEN {col} IS NULL THEN -1 ELSE CAST(dense_rank() OVER "
            f"(PARTITION BY {col} IS NULL ORDER BY {col}) - 1 AS BIGINT) END")


@query("prepare_health", with_sql(RAW_SQL) + f""",
p AS (SELECT *, "Coverage" || "Insurer" || "NCD" AS pk, nullif("DrivingExp", '>') AS de,
             CASE WHEN _c = 0 THEN NULL ELSE "Occupation" END AS occ
      FROM (SELECT *, row_id % 11 AS _c FROM raw))
SELECT row_id, "Price", {_code_sql('de')} AS "DrivingExp", {_factor_sql('occ')} AS "Occupation", {_code_sql('pk')} AS product_item
FROM p""")
def q_prepare_health(spark, sf):
    """E3 in the health files' shape: null-propagating target with the null
    class -1, codes with -1, codes with NULL."""
    from lacuna.operators.prepare import prepare_portfolio
    r = raw_quotes(spark, sf)
    r = r.withColumns({"DrivingExp": F.nullif(F.col("DrivingExp"), F.lit(">")),
                       "Occupation": F.when(F.col("row_id") % 11 != 0, F.col("Occupation"))})
    return prepare_portfolio(r, ["Coverage", "Insurer", "NCD"], ["DrivingExp"], ["Occupation"], ["Price"])


@query("prepare_vehicle", with_sql(RAW_SQL) + f""",
p AS (SELECT *, "Insurer" || "Coverage" AS pk, nullif("Make", 'nan') AS mk, {_number('"CarYear"')} AS made,
             upper(strftime("Date", '%d-%b-%y')) AS ds FROM raw)
SELECT row_id, "Price", {_factor_sql('mk')} AS "Make", {_code_sql('pk')} AS product_item,
       year(CAST(strptime(ds, '%d-%b-%y') AS DATE)) - made AS "Car.year"
FROM p""")
def q_prepare_vehicle(spark, sf):
    """E3 in the vehicle files' shape: two files, a 'dd-MMM-yy' date, the
    vehicle's age, null-propagating target with the null class -1."""
    from lacuna.operators.prepare import prepare_portfolio
    a, b = raw_sources(spark, sf)
    names = {"row_id": "row_id", "Insur Co": "Insurer", "Man. Year": "Year of manufacturer", "Sum Insured": "Sum of insured"}
    cols = ["row_id", "Insurer", "Coverage", "Make", "Settlement Date", "Year of manufacturer", "Sum of insured"]
    b = b.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in b.columns])
    u = union_sources([a.select(*[f"`{c}`" for c in cols]), b.select(*[f"`{c}`" for c in cols])])
    u = u.select("row_id", "Insurer", "Coverage", F.nullif(F.col("Make"), F.lit("nan")).alias("Make"),
                 F.col("`Sum of insured`").alias("Price"), C.to_number(F.col("`Year of manufacturer`")).alias("made"),
                 F.upper(F.date_format("Settlement Date", "dd-MMM-yy")).alias("ds"))
    return prepare_portfolio(u, ["Insurer", "Coverage"], [], ["Make"], ["Price"], "ds", "made")
