"""E3: raw quote files -> modelling table, as one lazy plan.

Only the dictionary fits (sorted distinct values, bounded by the check in
``Dictionary.fit``) and the class-frequency filter are jobs; everything else
is projection and filtering that Catalyst fuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import clean as C
from lacuna.operators.dictionary import factorize
from lacuna.operators.sample import rare_class_filter
from lacuna.sources.raw import (AGE_MAP, CAR_YEAR_MAP, CLEAN_COLS, DRIVING_EXP_MAP, INVALID_BRANDS, MAKE_MAP,
                                OCCUPATION_MAP)
from lacuna.session import cut_lineage
from lacuna.sources.tables import union_sources


def drop_duplicate_rows(df: DataFrame, cols: list[str], keep_min: str = "row_id") -> DataFrame:
    """P-04: exact-row dedupe over ``cols`` (NULLs equal); the surviving
    row is the one with the smallest ``keep_min`` (deterministic, unlike
    ``dropDuplicates`` which keeps an arbitrary row)."""
    return df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.min(keep_min).alias(keep_min))


def prepare_quotes(src1: DataFrame, src2: DataFrame, names1: list[str], names2: list[str]) -> DataFrame:
    r1 = src1.select("row_id", *[F.col(f"`{o}`").alias(n) for o, n in zip(names1, CLEAN_COLS)])
    r2 = src2.select("row_id", *[F.col(f"`{o}`").alias(n) for o, n in zip(names2, CLEAN_COLS)])
    df = union_sources([r1, r2])                                       # U-01
    df = df.na.drop(subset=["Insurer"])                                # P-02
    df = drop_duplicate_rows(df, CLEAN_COLS)                           # P-04
    df = df.withColumns({
        "Age": C.to_number(C.replace_values("Age", AGE_MAP)),
        "DrivingExp": C.to_number(C.strip_non_digits(C.replace_values("DrivingExp", DRIVING_EXP_MAP))),
        "Occupation": C.trim_ws(C.replace_values(C.keep_cjk_tail(C.cut_after("Occupation")), OCCUPATION_MAP)),
    })
    df = cut_lineage(df)  # the dictionary fits below re-read it: materialise once
    df = factorize(df, "Occupation", null_code=-1)
    df = df.withColumn("Occupation", C.null_if_code("Occupation"))
    df = df.withColumn("product_item", C.composite_filled("Insurer", "Coverage"))
    df = cut_lineage(rare_class_filter(df, "product_item", min_count=2).drop("Insurer", "Coverage"))
    df = df.withColumn("NCD", C.to_number("NCD"))
    df = factorize(df, "NCD", null_code=-1).withColumn("NCD", C.null_if_code("NCD"))
    make = C.replace_values(C.tokens_to_null(C.unbom_upper(C.trim_ws("Make")), INVALID_BRANDS), MAKE_MAP)
    df = df.withColumn("Make", make)
    df = factorize(df, "Make", null_code=-1).withColumn("Make", C.null_if_code("Make"))
    year = C.to_number(C.replace_values(C.trim_ws(F.col("`Car.year`")), CAR_YEAR_MAP))
    df = df.withColumn("Car.year", C.null_if_negative(C.age_from("Date", year)))
    # U-03: a table keeps no row order; where one is needed, ``ordered_positions`` gives it as a column
    return df.select("row_id", "Age", "DrivingExp", "Occupation", "NCD", "Make", F.col("`Car.year`").alias("Car.year"),
                     F.col("`Car.price`").alias("Car.price"), "product_item")


def prepare_portfolio(df: DataFrame, parts: list[str], sparse: list[str], nullable: list[str], keep: list[str],
                      date_text: str | None = None, made: str | None = None) -> DataFrame:
    """E3 for portfolio files: the target is the plain concatenation of
    ``parts``, whose missing values form a class of their own (-1);
    ``sparse`` columns become codes, missing ones -1 or, if ``nullable``,
    NULL; a 'dd-MMM-yy' date and a year give the age."""
    df = df.withColumn("product_item", C.composite_nullprop(*parts))
    if date_text is not None:
        df = df.withColumn("Car.year", C.age_from(C.parse_dd_mon_yy(date_text), F.col(made)))
    codes = ["product_item", *sparse, *nullable]
    df = cut_lineage(df.select("row_id", *keep, *codes, *(["`Car.year`"] if date_text is not None else [])))
    for c in codes:
        df = factorize(df, c, null_code=-1)
    return df.withColumns({c: C.null_if_code(c) for c in nullable}) if nullable else df
