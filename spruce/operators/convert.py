"""Type conversion: dirty numbers, numbers, dates (given, guessed, mixed), categorical."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.cols import c, is_numeric, order_key, require
from ..functions.text import strip_dirty_number, to_double_coerce


def clean_dirty_numeric(df: DataFrame, column: str) -> DataFrame:
    """Drop currency signs, thousands separators and blanks, then parse; bad -> null."""
    require(df, [column])
    return df.withColumn(column, to_double_coerce(strip_dirty_number(c(column))))


def convert_to_numeric(df: DataFrame, column: str, errors: str = "coerce") -> DataFrame:
    """Text -> double; ``errors='coerce'`` nulls bad values, ``'raise'`` fails the job."""
    require(df, [column])
    if is_numeric(df.schema[column].dataType):
        return df
    x = c(column)
    parsed = to_double_coerce(x)
    if errors == "raise":
        parsed = F.when(x.isNull() | parsed.isNotNull(), parsed).otherwise(
            F.raise_error(F.concat(F.lit(f"Unable to parse string in column {column}: "), x.cast("string"))))
    elif errors != "coerce":
        raise ValueError("errors must be 'coerce' or 'raise'")
    return df.withColumn(column, parsed)


def convert_to_datetime(df: DataFrame, column: str, fmt: str | None = None, order_by=None) -> DataFrame:
    """Text -> timestamp_ntz with a strftime format; bad -> null.

    Without a format, the format is guessed from the first non-null value
    (in ``order_by`` order) -- one bounded top-1 probe -- and then applied to
    every row; values written another way become null.  If the first value is
    written in no format that can be guessed, each value is parsed alone, as by
    ``convert_to_datetime_mixed``.  A zone (``%z``) moves the moment to UTC.
    """
    require(df, [column])
    x = c(column)
    if not (fmt or "").strip():  # blank: guess
        keys = order_key(df, order_by)
        first = df.where(x.isNotNull()).orderBy(*[c(k) for k in keys]).select(x.cast("string")).first()
        fmt = dates.guess_format(first[0] if first else None)
        if fmt is None:
            return df.withColumn(column, dates.parse_mixed(x))
    return df.withColumn(column, dates.parse_with_format(x, fmt))


def convert_to_datetime_mixed(df: DataFrame, column: str) -> DataFrame:
    """T5: each value parsed alone with the first format that fits it."""
    require(df, [column])
    return df.withColumn(column, dates.parse_mixed(c(column)))


def convert_to_categorical(df: DataFrame, column: str) -> DataFrame:
    """Text values, flagged as categorical in the column metadata."""
    require(df, [column])
    meta = dict(df.schema[column].metadata or {})
    meta["categorical"] = True
    return df.withColumn(column, c(column).cast("string").alias(column, metadata=meta))


def convert_type(df: DataFrame, columns, target: str, fmt: str | None = None, order_by=None) -> DataFrame:
    """The recipe's ``convert_type`` step over several columns."""
    t = target.lower()
    for k in ([columns] if isinstance(columns, str) else list(columns)):
        if t == "numeric":
            df = convert_to_numeric(df, k)
        elif t in ("numeric (dirty)", "dirty_numeric"):
            df = clean_dirty_numeric(df, k)
        elif t == "datetime":
            df = convert_to_datetime(df, k, fmt, order_by)
        elif t in ("datetime (mixed)", "datetime_mixed"):
            df = convert_to_datetime_mixed(df, k)
        elif t == "categorical":
            df = convert_to_categorical(df, k)
        else:
            raise ValueError(f"unknown conversion target {target!r}")
    return df
