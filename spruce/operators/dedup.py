"""Duplicates: find, list groups, one row per group, remove (keep first / last).

"First" means first in ``order_by`` order (extended by the other columns).

Which keys occur more than once is settled on fingerprints: each row's key columns become two 64-bit hashes, and only those are
counted (map-side combined).  Rows whose fingerprint is alone are no duplicates, whatever their size, and
are not moved.  Only the others, the candidates, are read again whole and compared exactly, so two keys with one
fingerprint cost time, never a wrong row.

A ``row_number()`` window per key would pull a hot key's whole group into
one task.  Where one row of each key is wanted Spark keeps the first of every task before the exchange
(``WindowGroupLimit``); where all others are wanted they are matched to it by
a join on the key (AQE splits a skewed key's partition).  Rows that are
identical in every column are interchangeable: they are counted, not told apart.
Null keys form one group, as in pandas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import as_list, c, order_key, quote, require

_KEYS = ["__dup_key1", "__dup_key2"]
KEYS_TO_BROADCAST = 1_000_000  # of 16 bytes each; more are joined by an exchange


def _subset(df: DataFrame, subset) -> list[str]:
    cols = require(df, as_list(subset)) if subset else \
        [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return cols


def row_key(cols: list[str]) -> tuple[Column, Column]:
    """128 bits of the cells and of which of them are null (the hash passes over nulls)."""
    cells = [x for k in cols for x in (c(k).isNull(), c(k))]
    return F.xxhash64(F.lit("a"), *cells), F.xxhash64(F.lit("b"), *cells)


def _fits_a_key(df: DataFrame, cols: list[str]) -> bool:
    """Whether the cells are no larger than their fingerprint."""
    kinds = [df.schema[k].dataType for k in cols]
    return len(kinds) <= 2 and all(isinstance(x, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) for x in kinds)


def _split(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key stands alone, the others): the others hold every row whose key occurs more than once."""
    from .stats import _materialize
    marked = df.withColumns(dict(zip(_KEYS, row_key(cols))))
    keys = marked.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*_KEYS)
    keys = _materialize(keys)
    if keys.count() <= KEYS_TO_BROADCAST:
        keys = F.broadcast(keys)
    return marked.join(keys, _KEYS, "left_anti").drop(*_KEYS), marked.join(keys, _KEYS, "left_semi").drop(*_KEYS)


def candidates(df: DataFrame, subset=None) -> DataFrame:
    """The rows among which every duplicate is; a few others may be there too."""
    cols = _subset(df, subset)
    return df if _fits_a_key(df, cols) else _split(df, cols)[1]


def _rank_key(df: DataFrame, order_by) -> Column:
    return F.struct(*[c(k) for k in order_key(df, order_by)])


def _key_join(left: DataFrame, right: DataFrame, subset: list[str], how: str = "inner") -> DataFrame:
    r = right.select(*[c(k).alias("__k_" + k) for k in subset],
                     *[F.col(quote(x)) for x in right.columns if x not in subset])
    cond = [F.col(quote(k)).eqNullSafe(F.col(quote("__k_" + k))) for k in subset]
    j = left.join(r, on=cond, how=how)
    return j.drop(*["__k_" + k for k in subset])


def _first_per_key(df: DataFrame, subset: list[str], order_by, keep: str) -> DataFrame:
    """The kept row of every key; Spark drops the others of a task before the exchange."""
    order = [c(k).asc_nulls_first() if keep == "first" else c(k).desc_nulls_last() for k in order_key(df, order_by)]
    at = F.row_number().over(Window.partitionBy(*[c(k) for k in subset]).orderBy(*order))
    return df.withColumn("__dup_at", at).where("__dup_at = 1").drop("__dup_at")


def remove_duplicates(df: DataFrame, subset=None, keep: str = "first", order_by=None) -> DataFrame:
    """One row per key, the first (or last) in order.

    Without a subset and without an order (all columns equal, any copy is as
    good as another) this is ``dropDuplicates()``.
    """
    keep = keep.lower()
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    cols = _subset(df, subset)
    if _fits_a_key(df, cols):
        alone, others = None, df
    else:
        alone, others = _split(df, cols)
    if not subset and order_by is None:
        kept = others.dropDuplicates()
    else:
        kept = _first_per_key(others, cols, order_by, keep)
    return kept if alone is None else alone.unionByName(kept)


def _repeats(df: DataFrame, subset: list[str], order_by) -> DataFrame:
    """The different rows with ``__times``, how often each stands behind the first of its key; ties by the other columns."""
    rows = df.groupBy(*[c(k) for k in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    if set(subset) >= set(order_key(df, None)):  # copies of whole rows: any of them is the first
        return rows.withColumn("__times", F.col("__n") - 1).where("__times > 0")
    rows = rows.withColumn("__rank", _rank_key(df, order_by))
    firsts = _first_per_key(df, subset, order_by, "first")
    firsts = firsts.select(*[c(k) for k in subset], _rank_key(df, order_by).alias("__first"))
    j = _key_join(rows, firsts, subset)
    j = j.withColumn("__times", F.col("__n") - (F.col("__rank") == F.col("__first")).cast("long"))
    return j.where("__times > 0").drop("__rank", "__first")


def find_duplicates(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    """Every row that repeats an earlier row of its key (not the first)."""
    cols = _subset(df, subset)
    rows = candidates(df, cols)
    order = as_list(order_by)
    if not order:
        found = _repeats(rows, cols, None)
    else:
        # rows behind the first place of their key are repeats; only rows that share that place are compared further
        place = F.struct(*[c(k) for k in order]) if len(order) > 1 else c(order[0])
        places = rows.groupBy(*[c(k) for k in cols], place.alias("__place")).agg(F.count(F.lit(1)).alias("__n"))
        by_place = F.struct(F.col("__place").isNotNull(), "__place")  # nulls first, as the order of a sort
        firsts = places.groupBy(*[c(k) for k in cols]).agg(F.min(F.struct(by_place.alias("p"), "__n")).alias("__f"))
        firsts = firsts.select(*[c(k) for k in cols], F.col("__f.p.__place").alias("__first"), F.col("__f.__n").alias("__n"))
        j = _key_join(rows.withColumn("__place", place), firsts, cols)
        behind = ~F.col("__place").eqNullSafe(F.col("__first"))
        later = j.where(behind).select(*[c(k) for k in df.columns])
        tied = j.where(~behind & (F.col("__n") > 1)).select(*[c(k) for k in df.columns])
        found = _repeats(tied, cols, order_by)
        found = found.unionByName(later.withColumns({"__n": F.lit(1).cast("long"), "__times": F.lit(1).cast("long")}))
    found = found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return found.select(*[c(k) for k in df.columns])


def duplicate_occurrences(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    """For every duplicated key, its first repeat (the second row in order)."""
    cols = _subset(df, subset)
    return _first_per_key(find_duplicates(df, cols, order_by), cols, order_by, "first")


def duplicate_groups(df: DataFrame, subset=None) -> DataFrame:
    """Every member of a key that occurs more than once, with the group size."""
    cols = _subset(df, subset)
    df = candidates(df, cols)
    counts = df.groupBy(*[c(k) for k in cols]).agg(F.count(F.lit(1)).alias("group_size")) \
        .where(F.col("group_size") > 1)
    return _key_join(df, counts, cols)
