"""Column-name helpers shared by every operator.

Names may hold dots, spaces or other characters that Spark would read as
a path; every operator goes through ``c()`` so that such names work.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """Column by exact name (dots and spaces are not paths)."""
    return F.col(quote(name))


def as_list(cols: str | Iterable[str] | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def check_names(df: DataFrame) -> None:
    """Spark resolves names case-insensitively; pandas does not. Fail early."""
    seen: dict[str, str] = {}
    for n in df.columns:
        k = n.lower()
        if k in seen and seen[k] != n:
            raise ValueError(f"columns {seen[k]!r} and {n!r} differ only in case")
        seen[k] = n


def require(df: DataFrame, cols: Iterable[str]) -> list[str]:
    cols = list(cols)
    missing = [x for x in cols if x not in set(df.columns)]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return cols


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def type_split(df: DataFrame) -> dict[str, list[str]]:
    """Numeric / categorical / all column lists from the schema."""
    return {"numeric": numeric_columns(df), "categorical": categorical_columns(df),
            "all": list(df.columns)}


def as_double(name: str) -> Column:
    """Numeric column as double with NaN turned into null (pandas 'missing')."""
    x = c(name).cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def order_key(df: DataFrame, order_by: str | Iterable[str] | None) -> list[str]:
    """Row order for order-dependent operators.

    Spark has no row position, so a caller names the order.  The given
    columns are extended by the remaining columns so that ties break the same
    way on every run; without ``order_by`` every column is used.
    """
    first = as_list(order_by)
    require(df, first)
    rest = [n for n in df.columns if n not in first and _orderable(df.schema[n].dataType)]
    return first + rest


def _orderable(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.MapType, T.VariantType)) if hasattr(T, "VariantType") \
        else not isinstance(dt, T.MapType)
