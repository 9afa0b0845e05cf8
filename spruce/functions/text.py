"""String expressions with Python/pandas semantics, built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that the case and trim operators turn into null
# afterwards (the reference's list).
NULL_TOKENS = ["", "nan", "None", "null"]

# Characters removed before parsing a dirty number.
DIRTY_NUMBER_CHARS = r"[£$€¥,\s]"

# Python's str.strip() whitespace: Unicode spaces plus the separators
# \x1c-\x1f, which Java's \s does not match.
_PY_SPACE = r"[\s\x1c-\x1f\x85\xa0]"
_STRIP = rf"(?U)^{_PY_SPACE}+|{_PY_SPACE}+$"

# A number as pandas.to_numeric reads it; Spark alone would also take
# '1d', '1f' or '0x1' style text.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INF = r"^\s*[+-]?(inf|infinity)\s*$"


def null_tokens_to_null(x: Column) -> Column:
    return F.when(x.isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(x)


def py_strip(x: Column) -> Column:
    return F.regexp_replace(x, _STRIP, "")


def py_title(x: Column) -> Column:
    """Python ``str.title``: upper-case the first letter of every run of letters."""
    runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    capped = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                  F.lower(F.substring(r, 2, 1 << 30))))
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(capped, ""))


def is_number_text(x: Column) -> Column:
    return x.rlike(_NUMBER) | F.lower(x).rlike(_INF)


def to_double_coerce(x: Column) -> Column:
    """Text -> double; anything pandas would not parse becomes null."""
    s = x.cast("string")
    return F.when(is_number_text(s), F.trim(s).try_cast("double"))


def strip_dirty_number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), DIRTY_NUMBER_CHARS, "")
