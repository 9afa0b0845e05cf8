"""Missing values: fill (mean, median, mode, constant, ffill, bfill), drop rows, drop sparse columns."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.cols import as_double, as_list, c, is_numeric, order_key, quote, require
from . import stats


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.withColumns(new) if new else df


def _null_or_nan(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c(name).isNull() | F.isnan(c(name))
    return c(name).isNull()


def fill_mean(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    cols = require(df, as_list(columns))
    st = stats.column_stats(df, cols, ["mean"])
    return _replace(df, {k: F.coalesce(as_double(k), F.lit(st[k]["mean"]).cast("double")) for k in cols})


def fill_median(df: DataFrame, columns: Iterable[str], exact: bool = True) -> DataFrame:
    cols = require(df, as_list(columns))
    med = (stats.column_quantiles(df, cols, [0.5]) if exact else
           {k: stats.quantiles(df, k, [0.5], exact=False) for k in cols})
    return _replace(df, {k: F.coalesce(as_double(k), F.lit(med[k][0]).cast("double")) for k in cols})


def fill_mode(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Most frequent value, smallest on ties; an all-null column stays as it is."""
    cols = require(df, as_list(columns))
    modes = stats.mode_values(df, cols)
    new = {}
    for k in cols:
        if modes.get(k) is None:
            continue
        dt = df.schema[k].dataType
        fill = F.lit(modes[k]).cast(dt)
        new[k] = F.when(_null_or_nan(df, k), fill).otherwise(c(k))
    return _replace(df, new)


def _constant_for(dt: T.DataType, value) -> tuple[Column, bool]:
    """A fill constant in the column's type (and whether the column becomes
    double); a value that does not fit fails."""
    if isinstance(dt, T.StringType):
        return F.lit(str(value)), False
    if is_numeric(dt):
        try:
            f = float(value)
        except (TypeError, ValueError):
            raise ValueError(f"constant {value!r} is not a number") from None
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and f.is_integer():
            return F.lit(int(f)).cast(dt), False
        return F.lit(f).cast("double"), True
    if isinstance(dt, T.BooleanType):
        if isinstance(value, bool):
            return F.lit(value), False
        s = str(value).strip().lower()
        if s in ("true", "false"):
            return F.lit(s == "true"), False
        raise ValueError(f"constant {value!r} is not a boolean")
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        try:
            parsed = value if isinstance(value, (_dt.date, _dt.datetime)) else \
                _dt.datetime.fromisoformat(str(value).strip())
        except ValueError:
            raise ValueError(f"constant {value!r} is not a date/time") from None
        return F.lit(parsed).cast(dt), False
    raise ValueError(f"cannot fill a constant into a {dt.simpleString()} column")


def fill_constant(df: DataFrame, columns: Iterable[str], constant) -> DataFrame:
    cols = require(df, as_list(columns))
    new = {}
    for k in cols:
        dt = df.schema[k].dataType
        v, widen = _constant_for(dt, constant)
        base = as_double(k) if widen else c(k)
        new[k] = F.when(_null_or_nan(df, k), v).otherwise(base)
    return _replace(df, new)


SAMPLE_A_RANGE = 64


def _range_of(df: DataFrame, key: dict[str, Column], ranges: int) -> Column:
    """Number of the range of a row's key; the bounds come from SAMPLE_A_RANGE keys for each range at most.

    Only keys reach the driver and the plan: the columns of the order and hashes, however wide the rows are.
    """
    names = list(key)
    picked = df.select(*[x.alias(n) for n, x in key.items()])
    kinds = {f.name: f.dataType for f in picked.schema.fields}
    picked = picked.orderBy(F.xxhash64(*names)).limit(SAMPLE_A_RANGE * ranges)
    rows = picked.orderBy(*names).collect() if ranges > 1 else []  # bounded by the limit
    bounds = sorted({len(rows) * i // ranges for i in range(1, ranges)}) if rows else []
    own = F.struct(*[x.alias(n) for n, x in key.items()])

    def at_or_above(places: list[int], low: int) -> Column:
        if not places:
            return F.lit(low)
        mid = len(places) // 2
        bound = F.struct(*[F.lit(v).cast(kinds[n]).alias(n) for v, n in zip(rows[places[mid]], names)])
        return F.when(own < bound, at_or_above(places[:mid], low)).otherwise(at_or_above(places[mid + 1:], low + mid + 1))

    return at_or_above(bounds, 0)


def fill_directional(df: DataFrame, columns: Iterable[str], order_by, forward: bool = True,
                     partition_by=None, num_buckets: int | None = None) -> DataFrame:
    """Forward (or backward) fill in ``order_by`` order, optionally per group.

    A single window over the whole table would run in one task.  Instead the
    rows are dealt to ranges of (group, order key) -- so a hot group or a
    run of ties is split over many tasks -- filled inside each range, and the
    last (first) non-null value of every range is carried over to the ranges
    after (before) it through a small table with one row per range and group.
    The ranges' bounds are read once, from a bounded sample of keys drawn by
    hash, and are literals in the plan: both branches see the same ranges, and nothing is cached.

    A key is a hash of the group, the columns of ``order_by`` and a hash of the row, which orders rows that are
    equal in all of ``order_by`` (the same way on every run); without ``order_by`` every column is one of the order.
    """
    cols = require(df, as_list(columns))
    part = require(df, as_list(partition_by))
    keys = [k for k in (require(df, as_list(order_by)) or order_key(df, None)) if k not in part]
    spark = df.sparkSession
    n_buckets = num_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pid, tie = "__fill_range", "__fill_tie"
    hashed = df.withColumn(tie, F.xxhash64(*[c(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]))
    key = {"g": F.xxhash64(*[c(k) for k in part]), **{f"k{i}": c(k) for i, k in enumerate(keys)}, "t": F.col(tie)}
    ranged = hashed.withColumn(pid, _range_of(hashed, key if part else {n: x for n, x in key.items() if n != "g"}, n_buckets))
    order = [*[c(k) for k in keys], F.col(tie)]
    # backward is forward in the opposite order: a frame to the end of its partition is computed anew for every row
    turned = order if forward else [x.desc() for x in order]
    w = Window.partitionBy(pid, *[c(k) for k in part]).orderBy(*turned).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"__l_{i}": F.last(_nanless(df, k), ignorenulls=True).over(w) for i, k in enumerate(cols)}
    filled = ranged.withColumns(local)

    key_struct = F.struct(*order)
    pick = F.max_by if forward else F.min_by
    edge = ranged.groupBy(pid, *[c(k) for k in part]).agg(
        *[pick(_nanless(df, k), F.when(_nanless(df, k).isNotNull(), key_struct)).alias(f"__e_{i}")
          for i, k in enumerate(cols)])
    gcols = [F.col(quote(k)) for k in part]
    cw = Window.partitionBy(*gcols).orderBy(pid if forward else F.desc(pid)).rowsBetween(Window.unboundedPreceding, -1)
    carry_exprs = [F.last(f"__e_{i}", ignorenulls=True).over(cw).alias(f"__c_{i}") for i in range(len(cols))]
    carry = edge.select(pid, *gcols, *carry_exprs)
    any_carry = F.lit(False)
    for i in range(len(cols)):
        any_carry = any_carry | F.col(f"__c_{i}").isNotNull()
    carry = carry.where(any_carry)
    keycols = [pid] + part
    carry = carry.select(*[F.col(quote(x)).alias("__k_" + x) if x in keycols else F.col(quote(x))
                           for x in carry.columns])
    cond = [F.col(pid) == F.col("__k_" + pid)]
    cond += [F.col(quote(k)).eqNullSafe(F.col(quote("__k_" + k))) for k in part]
    j = filled.join(carry, on=cond, how="left")
    out = {}
    for i, k in enumerate(cols):
        v = F.coalesce(F.col(f"__l_{i}"), F.col(f"__c_{i}"))
        out[k] = v.cast(df.schema[k].dataType)
    return j.withColumns(out).select(*[c(k) for k in df.columns])


def _nanless(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c(name)), c(name))
    return c(name)


def fill_missing(df: DataFrame, columns: Iterable[str], strategy: str, constant=None,
                 order_by=None, partition_by=None, exact: bool = True) -> DataFrame:
    """Dispatch on ``strategy`` as the reference's single fill entry point."""
    s = strategy.lower()
    if s == "mean":
        return fill_mean(df, columns)
    if s == "median":
        return fill_median(df, columns, exact=exact)
    if s == "mode":
        return fill_mode(df, columns)
    if s == "constant":
        return fill_constant(df, columns, constant)
    if s in ("ffill", "forward", "forward_fill"):
        return fill_directional(df, columns, order_by, True, partition_by)
    if s in ("bfill", "backward", "backward_fill"):
        return fill_directional(df, columns, order_by, False, partition_by)
    if s in ("drop", "drop_rows"):
        return drop_rows_with_nulls(df, columns)
    raise ValueError(f"unknown fill strategy {strategy!r}")


def drop_rows_with_nulls(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    cols = require(df, as_list(columns)) if columns else list(df.columns)
    cond = F.lit(True)
    for k in cols:
        cond = cond & ~_null_or_nan(df, k)
    return df.where(cond)


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """(rows, {column: missing cells}) in one scan."""
    exprs = {f"m{i}": F.count_if(_null_or_nan(df, k)) for i, k in enumerate(df.columns)}
    exprs["rows"] = F.count(F.lit(1))
    r = stats.one_row(df, exprs)
    return r["rows"], {k: r[f"m{i}"] for i, k in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, threshold_pct: float = 50.0) -> DataFrame:
    """Drop columns whose missing share is strictly above ``threshold_pct``."""
    rows, miss = missing_counts(df)
    if rows == 0:
        return df
    drop = [k for k, m in miss.items() if m / rows * 100 > threshold_pct]
    return df.drop(*drop)
