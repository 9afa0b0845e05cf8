"""Distinct counts and most frequent values of many columns, without moving the values.

Every cell becomes a 128-bit fingerprint, and the long-form table that is counted holds (column, fingerprint); the text of a
cell goes along only if the cell may be one of the most frequent.  Which ones may be is told by a
mergeable frequent-items sketch (``approx_top_k``) of the fingerprints, built in one pass over all columns:

* a value that the sketch does not name occurs in at most ``8 / TRACKED`` of the rows, or at most as often as the last one it
  names (the sketch's own error is under half of the first bound);
* the values that it names are counted exactly.  If the n-th of them occurs more often than any other value can,
  or if there are no others, the answer is exact and the bound is closed;
* for columns whose bound stays open (many values of nearly equal frequency) the full table of that column is counted.

So it is two scans for all columns together, and the first can carry other aggregates (``sketches``).  Two different cells of one column with equal fingerprints would count as
one distinct value; with 10^12 distinct values the chance of any is below 10^-14.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import as_double, c, is_numeric

TRACKED = 10_000  # items a sketch holds
NAMED = 128  # items it is asked for


@dataclass
class Frequencies:
    """Of one column: distinct non-null values, and the most frequent ones as (text, count), smallest first on ties."""
    distinct: int = 0
    top: list[tuple[str, int]] = field(default_factory=list)
    closed: bool = True


def _cell(df: DataFrame, name: str) -> Column:
    """The cell with NaN as null and one zero."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c(name)), c(name) + F.lit(0).cast(df.schema[name].dataType))
    return c(name)


def _key(df: DataFrame, name: str, seed: str) -> Column:
    cell = c(name).cast("string") if isinstance(df.schema[name].dataType, T.MapType) else _cell(df, name)
    return F.when(cell.isNotNull(), F.xxhash64(F.lit(seed), cell))


def sketches(df: DataFrame, of: Sequence[str]) -> list[Column]:
    """The aggregates of the first pass, for callers that have other aggregates to go with them."""
    return [F.count(F.lit(1)).alias("_n"), *[
        F.call_function("approx_top_k", _key(df, k, "a"), F.lit(NAMED), F.lit(TRACKED)).alias(f"_t{i}") for i, k in enumerate(of)]]


def frequencies(df: DataFrame, cols: Sequence[str], top: int = 0, of: Sequence[str] | None = None, told: Row | None = None) -> dict[str, Frequencies]:
    """:class:`Frequencies` of every column in ``cols``, with the ``top`` most frequent values of those in ``of`` (all).

    ``told`` is the row of ``sketches(df, of)`` if it is there already.
    """
    cols = list(dict.fromkeys(cols))
    out = {k: Frequencies() for k in cols}
    if not cols:
        return out
    of = [k for k in (cols if of is None else of) if k in out] if top else []
    named: dict[str, list] = {}
    limit: dict[str, float] = {}
    if of:
        told = told or df.agg(*sketches(df, of)).first()
        for i, k in enumerate(of):
            found = told[f"_t{i}"] or []
            named[k] = [r["item"] for r in found if r["item"] is not None]
            limit[k] = max(8 * told["_n"] / TRACKED, found[-1]["count"] if len(found) >= NAMED else 0)
    cells = []
    for i, k in enumerate(cols):
        key = _key(df, k, "a")
        value = F.when(key.isin(named[k]), _cell(df, k).cast("string")) if named.get(k) else F.lit(None).cast("string")
        cells.append(F.struct(F.lit(i).alias("_c"), key.alias("_k"), _key(df, k, "b").alias("_l"), value.alias("_v"),
                              (F.when(value.isNotNull(), as_double(k)) if is_numeric(df.schema[k].dataType) else F.lit(None).cast("double")).alias("_x")))
    counts = df.select(F.explode(F.array(*cells)).alias("_i")).select("_i.*").where("_k IS NOT NULL").groupBy("_c", "_k", "_l", "_v", "_x").agg(
        F.count(F.lit(1)).alias("_n"))
    # one row a column, and at most ``top`` rows more; both read every column of the one exchange, so that Spark makes it once
    none = F.lit(None)
    rows = counts.groupBy("_c").agg(F.count(F.lit(1)).alias("distinct"), F.count("_v").alias("named"), F.sum("_n").alias("cells"), F.max("_x").alias("_x"),
                                    F.max("_l").alias("_l")).select("*", none.cast("string").alias("_v"), none.cast("int").alias("at"))
    if of:
        empty = [none.cast("long").alias(k) for k in ("distinct", "named")]
        rows = rows.unionByName(_ranked(counts, top).select("_c", *empty, F.col("_n").alias("cells"), "_x", "_l", "_v", "at"))
    every: dict[str, bool] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["_c"], r["at"] or 0)):
        k = cols[r["_c"]]
        if r["distinct"] is not None:
            out[k].distinct, every[k] = r["distinct"], r["distinct"] == r["named"]
        elif r["_v"] is not None:
            out[k].top.append((r["_v"], r["cells"]))
    open_ = [k for k in of if out[k].distinct and not every[k] and not (len(out[k].top) == top and out[k].top[-1][1] > limit[k])]
    if open_:
        _count_all(df, open_, top, out)
    return out


def _ranked(counts: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each column; Spark drops the others of a task before the exchange."""
    order = Window.partitionBy("_c").orderBy(F.col("_v").isNull(), F.desc("_n"), F.col("_x").asc_nulls_last(), "_v")
    return counts.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top)


def _count_all(df: DataFrame, cols: list[str], top: int, out: dict[str, Frequencies]) -> None:
    from .profile import frequency_table
    full = frequency_table(df, cols).select(F.col("column").alias("_c"), F.col("value").alias("_v"), F.col("num_key").alias("_x"), F.col("count").alias("_n"))
    for k in cols:
        out[k].top, out[k].closed = [], False
    for r in sorted(_ranked(full, top).collect(), key=lambda r: (r["_c"], r["at"])):
        out[r["_c"]].top.append((r["_v"], r["_n"]))
