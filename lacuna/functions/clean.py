"""P-01..P-19: cleaning scalars as column expressions (codegen, no UDFs).

Each function returns a ``Column``; they compose inside one projection and
apply unchanged to batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as text stripping knows it, and a decimal numeral.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NUMERAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def replace_values(c, mapping: dict) -> Column:
    """P-05: literal dictionary replace; a value may map to None (-> NULL).
    Values not in the dictionary pass through.  (Large dictionaries belong in
    a broadcast join: ``operators.dictionary``.)"""
    col = _c(c)
    if not mapping:
        return col
    out = None
    for k, v in mapping.items():
        out = (F.when(col == F.lit(k), F.lit(v)) if out is None else out.when(col == F.lit(k), F.lit(v)))
    return out.otherwise(col)


def tokens_to_null(c, tokens: list) -> Column:
    """P-06: listed tokens -> NULL."""
    col = _c(c)
    return F.when(col.isin(list(tokens)), F.lit(None)).otherwise(col)


def to_number(c) -> Column:
    """P-07: lenient numeric parse.  Only decimal numerals (sign, digits,
    point, exponent) count, with white space around them; all else, 'nan' and
    type suffixes such as '10d' included, is NULL and never an error."""
    text = trim_ws(_c(c).cast("string"))
    return F.when(text.rlike(NUMERAL), text.try_cast("double"))


def strip_non_digits(c) -> Column:
    """P-08: remove every non-digit character."""
    return F.regexp_replace(_c(c), r"[^0-9]", "")


def cut_after(c, delimiter_regex: str = r"\|") -> Column:
    """P-09: drop the delimiter and everything after it."""
    return F.regexp_replace(_c(c), delimiter_regex + ".*", "")


def keep_cjk_tail(c) -> Column:
    """P-10: 'english 中文...' -> '中文...' (first space followed by a CJK char)."""
    return F.regexp_replace(_c(c), r".*? ([一-龥].*)", "$1")


def trim_ws(c) -> Column:
    """P-11: strip leading/trailing Unicode white space, U+3000 included
    (``trim`` strips spaces only)."""
    return F.regexp_replace(_c(c), f"^[{WHITE}]+|[{WHITE}]+$", "")


def unbom_upper(c) -> Column:
    """P-12: remove U+FEFF and upper-case."""
    return F.upper(F.regexp_replace(_c(c), "\ufeff", ""))


def composite_filled(a, b, fill: str = "Missing", sep: str = "|") -> Column:
    """P-13: a|b with NULL parts written as ``fill``; NULL iff both NULL."""
    ca, cb = _c(a), _c(b)
    return F.when(ca.isNull() & cb.isNull(), F.lit(None)).otherwise(
        F.concat_ws(sep, F.coalesce(ca.cast("string"), F.lit(fill)), F.coalesce(cb.cast("string"), F.lit(fill))))


def composite_nullprop(*parts) -> Column:
    """P-14: plain concatenation, NULL if any part is NULL."""
    return F.concat(*[_c(p).cast("string") for p in parts])


def parse_dd_mon_yy(c) -> Column:
    """P-15: 'dd-MMM-yy' (case-insensitive month) -> date with the C-library
    two-digit-year pivot (69..99 -> 19xx, 00..68 -> 20xx); Spark's own
    pattern maps every yy into 2000..2099."""
    d = F.to_date(F.initcap(_c(c)), "dd-MMM-yy")
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def age_from(date_col, year_col) -> Column:
    """P-16: year(date) - year."""
    return F.year(_c(date_col)) - _c(year_col)


def null_if_negative(c) -> Column:
    """P-17: negative -> NULL."""
    col = _c(c)
    return F.when(col >= 0, col)


def null_if_code(c, code: int = -1) -> Column:
    """P-18: a sentinel code -> NULL."""
    return F.nullif(_c(c), F.lit(code))


def round_half_even(c) -> Column:
    """P-19: round half to even, to a long code (``round`` is half-up)."""
    return F.rint(_c(c)).cast("long")
