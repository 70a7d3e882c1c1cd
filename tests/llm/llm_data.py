"""Paths and rows shared by the tests of the training-data operators."""

import re

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    near = " ".join(f"w{i}" for i in range(120))
    near2 = " ".join(f"w{i}" if i != 60 else "changed" for i in range(120))
    long_text = " ".join(f"token{i % 997} and{i % 31}" for i in range(40_000))
    return [
        (1, "alpha beta  gamma", "en", "s", 1), (2, "alpha\tbeta gamma", "en", "s", 1), (2, "alpha beta gamma", "en", "s", 1),
        (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \n ", "en", "s", 3), (None, "no id here", None, "s", 1),
        (None, "alpha beta gamma", None, "s", 1), (6, near, "en", "s", 1), (7, near2, "en", "s", 1), (7, near2, "en", "s", 1),
        (8, long_text, "en", "s", 1), (9, long_text + " end", "en", "s", 1),
        (10, "short text", "en", "s", 1), (11, "zwölf Wörter \U0001F600 漢字 ' s's 'll  \n\n x", "de", "s", 1),
    ]
