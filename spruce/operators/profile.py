"""Profiling: column profile, describe, missing table, duplicates, previews, top values.

Every profile is a small DataFrame built from one or two scans of the table:
counts of all columns come from one aggregate; distinct counts and top
values come from fingerprints of the cells (see ``heavy``), or, where every value is asked for,
from one long-form frequency table (every column unpivoted to
(column, value) and counted with map-side combine, so hot values cost one
row per task and no ``count(DISTINCT)`` expands the rows once per column).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import (as_double, as_list, c, categorical_columns, is_numeric, numeric_columns,
                              order_key, require)
from . import stats
from .dedup import candidates
from .heavy import frequencies, sketches


def _value(df: DataFrame, name: str) -> Column:
    """Cell as text with NaN as null (pandas treats NaN as missing)."""
    dt = df.schema[name].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        # adding zero makes -0.0 and 0.0 one value
        return F.when(~F.isnan(c(name)), c(name) + F.lit(0).cast(dt)).cast("string")
    return c(name).cast("string")


def _missing(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c(name).isNull() | F.isnan(c(name))
    return c(name).isNull()


def frequency_table(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Long form (column, value, count, num_key): non-null value counts of every column.

    ``value`` is the text form; ``num_key`` is the value as double for numeric
    columns (for numeric tie-breaking), else null.
    """
    cols = require(df, as_list(cols) if cols is not None else list(df.columns))
    items = []
    for k in cols:
        dt = df.schema[k].dataType
        key = as_double(k) if is_numeric(dt) else F.lit(None).cast("double")
        items.append(F.struct(F.lit(k).alias("column"), _value(df, k).alias("value"), key.alias("num_key")))
    long = df.select(F.explode(F.array(*items)).alias("_i")).select("_i.*")
    return (long.where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"), F.min("num_key").alias("num_key")))


def _column_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(ordinal, column, dtype, non_null, nulls, rows) from one aggregate."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, k in enumerate(cols):
        aggs.append(F.count_if(_missing(df, k)).alias(f"_m{i}"))
    one = df.agg(*aggs)
    items = [F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("column"),
                      F.lit(df.schema[k].dataType.simpleString()).alias("dtype"),
                      F.col(f"_m{i}").alias("nulls")) for i, k in enumerate(cols)]
    t = one.select(F.col("_rows").alias("rows"), F.explode(F.array(*items)).alias("_c"))
    return t.select("_c.ordinal", "_c.column", "_c.dtype", "rows",
                    (F.col("rows") - F.col("_c.nulls")).alias("non_null_count"),
                    F.col("_c.nulls").alias("null_count"))


def _pct(num: Column, den: Column, dp: int) -> Column:
    return F.round(F.try_divide(num.cast("double"), den.cast("double")) * 100, dp)


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """column, dtype, non_null_count, null_count, null_pct (2 dp), unique_count."""
    cols = list(df.columns)
    base = _column_table(df, cols)
    if approx:
        one = df.agg(*[F.approx_count_distinct(_value(df, k)).alias(f"_d{i}") for i, k in enumerate(cols)])
        uniq = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("column"),
                                                        F.col(f"_d{i}").alias("unique_count"))
                                               for i, k in enumerate(cols)])).alias("_u")).select("_u.*")
    else:
        uniq = df.sparkSession.createDataFrame([(k, f.distinct) for k, f in frequencies(df, cols).items()],
                                               "`column` string, unique_count long")
    out = base.join(uniq, on="column", how="left")
    return out.select("column", "dtype", "non_null_count", "null_count",
                      _pct(F.col("null_count"), F.col("rows"), 2).alias("null_pct"),
                      F.coalesce(F.col("unique_count"), F.lit(0)).cast("long").alias("unique_count"),
                      "ordinal")


def numeric_describe(df: DataFrame, columns: Iterable[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max per numeric column."""
    cols = as_list(columns) if columns is not None else numeric_columns(df)
    cols = [k for k in require(df, cols) if is_numeric(df.schema[k].dataType)]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, count long, mean double, std double, min double, q25 double, "
                "q50 double, q75 double, max double")
    qs = (stats.column_quantiles(df, cols, [0.25, 0.5, 0.75]) if exact else
          {k: stats.quantiles(df, k, [0.25, 0.5, 0.75], exact=False) for k in cols})
    aggs = []
    for i, k in enumerate(cols):
        x = as_double(k)
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_a{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                 F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    one = df.agg(*aggs)
    items = [F.struct(F.lit(k).alias("column"), F.col(f"_n{i}").alias("count"), F.col(f"_a{i}").alias("mean"),
                      F.col(f"_s{i}").alias("std"), F.col(f"_lo{i}").alias("min"),
                      F.lit(qs[k][0]).cast("double").alias("q25"), F.lit(qs[k][1]).cast("double").alias("q50"),
                      F.lit(qs[k][2]).cast("double").alias("q75"), F.col(f"_hi{i}").alias("max"))
             for i, k in enumerate(cols)]
    return one.select(F.explode(F.array(*items)).alias("_d")).select("_d.*")


def categorical_describe(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """count, unique, top, freq per text column (top: most frequent, smallest on ties)."""
    cols = as_list(columns) if columns is not None else categorical_columns(df)
    cols = require(df, cols)
    base = _column_table(df, cols)
    freq = df.sparkSession.createDataFrame([(k, f.distinct, *(f.top[0] if f.top else (None, None))) for k, f in frequencies(df, cols, 1).items()],
                                           "`column` string, unique long, top string, freq long")
    out = base.join(freq, on="column", how="left")
    return out.select("column", F.col("non_null_count").alias("count"),
                      F.coalesce(F.col("unique"), F.lit(0)).cast("long").alias("unique"), "top", "freq")


def missing_table(df: DataFrame) -> DataFrame:
    """column, missing_count, missing_pct (2 dp), only columns with missing values."""
    t = _column_table(df, list(df.columns))
    return t.where(F.col("null_count") > 0).select(
        "column", F.col("null_count").alias("missing_count"),
        _pct(F.col("null_count"), F.col("rows"), 2).alias("missing_pct"), "ordinal")


def missing_bands(df: DataFrame) -> DataFrame:
    """missing table sorted by share, with a severity band (< 5, < 20, else)."""
    m = missing_table(df)
    band = (F.when(F.col("missing_pct") < 5, F.lit("low"))
            .when(F.col("missing_pct") < 20, F.lit("medium")).otherwise(F.lit("high")))
    return m.withColumn("band", band).orderBy(F.col("missing_pct").desc(), F.col("column"))


def _groupable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def duplicate_stats(df: DataFrame) -> DataFrame:
    """rows, duplicate rows (repeats of an earlier row), duplicate_pct (2 dp).

    Rows are told apart by fingerprints; only rows whose fingerprint occurs twice are grouped whole (see ``dedup``).
    """
    one = _with_duplicates(df, F.lit(0)).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_d"), F.lit(0)).alias("duplicates"))
    return one.select("rows", "duplicates",
                      F.when(F.col("rows") > 0, _pct(F.col("duplicates"), F.col("rows"), 2))
                      .otherwise(F.lit(0.0)).alias("duplicate_pct"))


def _with_duplicates(df: DataFrame, missing: Column) -> DataFrame:
    """(_n, _d, _m): a row for each row of ``df`` with its missing cells, and one for each group of copies with its repeats."""
    none = F.lit(0).cast("long")
    groups = candidates(df).groupBy(*[c(k) for k in _groupable(df)]).agg((F.count(F.lit(1)) - 1).alias("_d")).where("_d > 0")
    rows = df.select(F.lit(1).cast("long").alias("_n"), none.alias("_d"), missing.cast("long").alias("_m"))
    return rows.unionByName(groups.select(none.alias("_n"), "_d", none.alias("_m")))


def overview(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells, missing % of cells (1 dp), duplicates (as F5)."""
    miss = F.lit(0)
    for k in df.columns:
        miss = miss + _missing(df, k).cast("long")
    one = _with_duplicates(df, miss).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_d"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("missing_cells"))
    ncols = len(df.columns)
    cells = F.col("rows") * F.lit(ncols)
    return one.select("rows", F.lit(ncols).cast("long").alias("columns"), "missing_cells",
                      F.when(cells > 0, _pct(F.col("missing_cells"), cells, 1)).otherwise(F.lit(0.0))
                      .alias("missing_pct"), "duplicates")


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n most frequent non-null values (ties: smallest value first)."""
    require(df, [column])
    found = frequencies(df, [column], n)[column].top
    return df.sparkSession.createDataFrame(found, "value string, count long")


def dataset_context(df: DataFrame, top_n: int = 5) -> DataFrame:
    """F8: per column dtype, nulls, null % (1 dp), distinct, top values (text) or min/max (numbers)."""
    cols = list(df.columns)
    nums = numeric_columns(df)
    text = categorical_columns(df)
    # nulls, ranges and sketches of all columns in one scan, distinct counts and top values in another
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(_missing(df, k)).alias(f"_m{i}") for i, k in enumerate(cols)],
                 *[f(as_double(k)).alias(f"_{n}{cols.index(k)}") for k in nums for f, n in ((F.min, "lo"), (F.max, "hi"))], *sketches(df, text)).first()
    freq = frequencies(df, cols, top_n, text, one)
    rows = []
    for i, k in enumerate(cols):
        ends = (one[f"_lo{i}"], one[f"_hi{i}"]) if k in nums else (None, None)
        tops = ", ".join(v for v, _ in freq[k].top) if freq[k].top else None
        rows.append((k, df.schema[k].dataType.simpleString(), one[f"_m{i}"], one["_rows"], freq[k].distinct, tops, *ends, i))
    out = df.sparkSession.createDataFrame(
        rows, "`column` string, dtype string, null_count long, rows long, unique_count long, top_values string, min double, max double, ordinal int")
    return out.select("column", "dtype", "null_count", _pct(F.col("null_count"), F.col("rows"), 1).alias("null_pct"),
                      "unique_count", "top_values", "min", "max", "ordinal")


def context_rows(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """F8: the first ``n`` rows in ``order_by`` order as (row, ordinal, column, value), cells as text."""
    keys = order_key(df, order_by)
    first = df.orderBy(*[c(k) for k in keys]).limit(n)
    cells = [F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("column"), c(k).cast("string").alias("value")) for i, k in enumerate(df.columns)]
    at = F.row_number().over(Window.orderBy(*[c(k) for k in keys]))  # over n rows
    return first.select(at.alias("row"), F.array(*cells).alias("_a")).select("row", F.explode("_a").alias("_c")).select("row", "_c.*")


def distinct_values(df: DataFrame, column: str, n: int | None = 50) -> DataFrame:
    """distinct non-null values of a column, smallest first, first ``n``."""
    require(df, [column])
    d = df.select(c(column)).where(~_missing(df, column)).distinct().orderBy(c(column))
    return d.limit(n) if n else d


def before_after_nulls(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows and missing cells of two versions of a table, one row each."""
    def side(d: DataFrame, stage: str) -> DataFrame:
        miss = F.lit(0)
        for k in d.columns:
            miss = miss + _missing(d, k).cast("long")
        return d.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(miss), F.lit(0)).alias("missing_cells")) \
            .select(F.lit(stage).alias("stage"), "rows", "missing_cells")
    return side(before, "before").unionByName(side(after, "after"))


def before_after_describe(before: DataFrame, after: DataFrame, columns: Iterable[str],
                          exact: bool = True) -> DataFrame:
    """numeric describe of the same columns before and after a change."""
    cols = as_list(columns)
    b = numeric_describe(before, cols, exact).select(F.lit("before").alias("stage"), "*")
    a = numeric_describe(after, cols, exact).select(F.lit("after").alias("stage"), "*")
    return b.unionByName(a)


def head_preview(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """L1: first n rows in ``order_by`` order (a top-k, not a full sort)."""
    keys = order_key(df, order_by)
    return df.orderBy(*[c(k) for k in keys]).limit(n)


def tail_preview(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """L2: last n rows in ``order_by`` order, shown in that order."""
    keys = order_key(df, order_by)
    last = df.orderBy(*[c(k).desc() for k in keys]).limit(n)
    return last.orderBy(*[c(k) for k in keys])


def sample_types(df: DataFrame, order_by=None) -> DataFrame:
    """P10: column, type, first row's value as text."""
    first = head_preview(df, 1, order_by)
    items = [F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("column"),
                      F.lit(df.schema[k].dataType.simpleString()).alias("dtype"),
                      c(k).cast("string").alias("sample")) for i, k in enumerate(df.columns)]
    return first.select(F.explode(F.array(*items)).alias("_s")).select("_s.*")


def profile(df: DataFrame, exact: bool = True) -> dict[str, DataFrame]:
    """All profile tables of one table (each a small DataFrame)."""
    return {
        "overview": overview(df),
        "columns": column_profile(df),
        "missing": missing_table(df),
        "numeric": numeric_describe(df, exact=exact),
        "categorical": categorical_describe(df),
        "duplicates": duplicate_stats(df),
    }
