"""Shared statistics: one-row aggregates and exact quantiles.

Operators that need statistics (fill mean, IQR bounds, scaling, ...) follow
the fit/transform pattern of Spark ML: one aggregate job computes every
statistic of every column at once, the single result row comes back to the
driver, and the transform uses the numbers as literals (constant-folded,
whole-stage codegen).  Only one row crosses to the driver, never data.

Exact quantiles
---------------
Spark's ``percentile``/``median`` merge a value->count map of the whole
column inside one final task; on a 100 TB column with many distinct values
that task does not fit.  Here a sketch says where to look, and counting says what is there:

1. the first pass builds ``percentile_approx``'s mergeable summary, whose ranks are off by at most 1/``ACCURACY`` of the
   rows.  Asked a little below and above each probability it gives a bracket of two values, between which the ranks
   sought lie;
2. the last pass counts the rows between the brackets (one number each, with the smallest and largest value) and the
   different values inside them.  Their running sum is every value's exact rank, so the answer does
   not rest on the sketch: a rank that its bracket does not hold is an error, never a wrong value.

Brackets hold about 4/``ACCURACY`` of the rows each.  Where that is more than ``SELECT`` values (from thousands of millions of
rows on) one more pass narrows them by summaries of the brackets themselves; so it is two or three passes.
Columns share all passes; groups are the keys of the same aggregates, and the brackets a small table joined on the group.  The
interpolation is that of ``percentile``/``quantile_cont``.  ``exact=False`` uses ``percentile_approx`` alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cols import as_double, as_list, c

ACCURACY = 10_000  # of the summaries: ranks are off by at most 1 / ACCURACY of the rows
SELECT = 2_000_000  # values that brackets may hold before they are narrowed once
GROUPS_TO_BROADCAST = 50_000  # brackets of more groups are joined by an exchange


def one_row(df: DataFrame, exprs: dict[str, Column]) -> Row:
    """Evaluate all aggregate expressions in one job; returns the single row."""
    if not exprs:
        return Row()
    return df.agg(*[e.alias(k) for k, e in exprs.items()]).first()


def column_stats(df: DataFrame, cols: Sequence[str], kinds: Iterable[str]) -> dict[str, dict]:
    """mean / std / min / max / count / nulls of many columns in one scan."""
    kinds = list(kinds)
    exprs: dict[str, Column] = {}
    for i, name in enumerate(cols):
        x = as_double(name)
        for k in kinds:
            if k == "mean":
                exprs[f"{i}_mean"] = F.avg(x)
            elif k == "std":
                exprs[f"{i}_std"] = F.stddev_samp(x)
            elif k == "min":
                exprs[f"{i}_min"] = F.min(x)
            elif k == "max":
                exprs[f"{i}_max"] = F.max(x)
            elif k == "count":
                exprs[f"{i}_count"] = F.count(x)
            elif k == "nulls":
                exprs[f"{i}_nulls"] = F.count_if(x.isNull())
            else:
                raise ValueError(f"unknown statistic {k!r}")
    if "rows" in kinds:
        exprs["rows"] = F.count(F.lit(1))
    row = one_row(df, exprs).asDict()
    out = {name: {k: row[f"{i}_{k}"] for k in kinds if k != "rows"} for i, name in enumerate(cols)}
    if "rows" in kinds:
        out["__rows__"] = row["rows"]
    return out


def quantiles(df: DataFrame, value: str, probs: Sequence[float], exact: bool = True,
              accuracy: int = 10000) -> list[float | None]:
    """Quantiles of one column over the whole table (nulls and NaN skipped)."""
    probs = [float(p) for p in probs]
    if not exact:
        t = quantile_table(df, value, probs, by=(), exact=False, accuracy=accuracy).first()
        return [None] * len(probs) if t is None else [t[f"q{j}"] for j in range(len(probs))]
    return column_quantiles(df, [value], probs)[value]


def quantile_table(df: DataFrame, value: str, probs: Sequence[float], by: str | Iterable[str] = (),
                   exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """One row per non-null group: group columns then ``q0 .. q{k-1}``.

    Rows with a null group key are dropped (as pandas ``groupby`` does).
    """
    by = as_list(by)
    probs = [float(p) for p in probs]
    if any(p < 0 or p > 1 for p in probs):
        raise ValueError("quantile probabilities must lie in [0, 1]")
    gnames = [f"_g{i}" for i in range(len(by))]
    base = df.select(*[c(k).alias(g) for k, g in zip(by, gnames)], as_double(value).alias("_v"))
    base = base.where(F.col("_v").isNotNull())
    for g in gnames:
        base = base.where(F.col(g).isNotNull())
    if not exact:
        out = base.groupBy(*gnames).agg(
            F.percentile_approx("_v", probs, accuracy).alias("_qs"))
        return out.select(*[F.col(g).alias(k) for g, k in zip(gnames, by)],
                          *[F.col("_qs")[j].alias(f"q{j}") for j in range(len(probs))])
    if not by:
        found = column_quantiles(base, ["_v"], probs)["_v"]
        names = [f"q{j}" for j in range(len(probs))]
        return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"{k} double" for k in names))
    return _grouped_quantiles(base, gnames, by, probs)


def _bracket_shares(probs: Sequence[float]) -> list[float]:
    """Where the summaries are asked: two below, then two above, for each probability."""
    wide = 2.0 / ACCURACY
    return [x for p in probs for x in (max(0.0, p - wide), min(1.0, p + wide))]


def _ends(of: Column, count: int) -> list[Column]:
    """The brackets' lower and upper ends, from the summary's answers."""
    return [F.array(*[of[2 * j + side] for j in range(count)]).alias(name) for side, name in ((0, "_lo"), (1, "_hi"))]


def _counted(rows: DataFrame, keys: list[str], count: int, *more: Column) -> DataFrame:
    """Rows (keys, _v, _n, _lo, _hi) counted: one row for each stretch between brackets, one for each value inside them.

    ``_before`` is the number of rows with a smaller value; ``more`` aggregates over stretches and whole brackets instead.
    """
    up = sum(((F.get("_lo", F.lit(j)) <= F.col("_v")).cast("int") for j in range(count)), F.lit(0))
    past = sum(((F.get("_hi", F.lit(j)) < F.col("_v")).cast("int") for j in range(count)), F.lit(0))
    value = [] if more else [F.when(up > past, F.col("_v")).alias("_w")]
    counts = rows.groupBy(*keys, "_n", (up + past).alias("_at"), (up > past).alias("_inside"), *value).agg(
        F.count(F.lit(1)).alias("_nb"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), *more)
    order = Window.partitionBy(*keys).orderBy("_at", *([] if more else ["_w"])).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_nb").over(order), F.lit(0)))


def _rank(p: float, side: int) -> Column:
    """The lower or upper rank that the probability falls between."""
    low = F.floor(F.lit(p) * (F.col("_n") - 1)).cast("long")
    return F.least(low + 1, F.col("_n") - 1) if side else low


def _holds(rank: Column) -> Column:
    return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_nb"))


def _at_rank(rank: Column) -> Column:
    """The value of a rank in a stretch: known if it is the stretch's only value, its first or its last."""
    last = F.col("_before") + F.col("_nb") - 1
    value = F.when((F.col("_least") == F.col("_most")) | (rank == F.col("_before")), F.col("_least")).when(rank == last, F.col("_most"))
    return F.when(_holds(rank), value.otherwise(F.raise_error(F.lit("a quantile's rank lies outside its bracket")).cast("double")))


def _selected(rows: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """(keys, q0 ..): the last pass."""
    counts = _counted(rows, keys, len(probs))
    ends = [F.max(_at_rank(_rank(p, side))).alias(f"_e{j}_{side}") for j, p in enumerate(probs) for side in (0, 1)]
    found = counts.groupBy(*keys, "_n").agg(*ends)
    out = []
    for j, p in enumerate(probs):
        lo, hi, at = F.col(f"_e{j}_0"), F.col(f"_e{j}_1"), F.lit(p) * (F.col("_n") - 1)
        frac = at - F.floor(at)
        out.append(F.when((lo == hi) | (frac == 0), lo).otherwise(lo + frac * (hi - lo)).alias(f"q{j}"))
    return found.select(*keys, *out)


def _narrowed(rows: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """(keys, _n, _lo, _hi): the brackets of every rank within the brackets of ``rows``, by one pass of summaries."""
    steps = max(2, ACCURACY // 10)  # a step is ten times the summaries' error
    shares = F.percentile_approx("_v", [i / steps for i in range(steps + 1)], ACCURACY).alias("_s")
    counts = _counted(rows, keys, len(probs), shares)

    def end(p, rank_side, side):
        rank = _rank(p, rank_side)
        step = F.floor((rank - F.col("_before")) * steps / F.col("_nb")).cast("int")
        near = F.get("_s", F.greatest(step - 2, F.lit(0)) if side == 0 else F.least(step + 3, F.lit(steps)))
        return F.when(F.col("_inside") & _holds(rank), near).otherwise(_at_rank(rank))

    lows = [F.min(F.least(end(p, 0, 0), end(p, 1, 0))).alias(f"_l{j}") for j, p in enumerate(probs)]
    highs = [F.max(F.greatest(end(p, 0, 1), end(p, 1, 1))).alias(f"_h{j}") for j, p in enumerate(probs)]
    found = counts.where("_nb > 0").groupBy(*keys, "_n").agg(*lows, *highs)
    return found.select(*keys, "_n", F.array(*[f"_l{j}" for j in range(len(probs))]).alias("_lo"),
                        F.array(*[f"_h{j}" for j in range(len(probs))]).alias("_hi"))


def _too_many(n: int | None, count: int) -> bool:
    return (n or 0) * count * 4 / ACCURACY > SELECT


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of many columns; the columns share every pass."""
    columns, probs = list(dict.fromkeys(columns)), [float(p) for p in probs]
    if any(p < 0 or p > 1 for p in probs):
        raise ValueError("quantile probabilities must lie in [0, 1]")
    if not columns:
        return {}
    x = [as_double(k) + F.lit(0.0) for k in columns]  # one zero
    ask = {**{f"n{i}": F.count(v) for i, v in enumerate(x)},
           **{f"s{i}": F.percentile_approx(v, _bracket_shares(probs), ACCURACY) for i, v in enumerate(x)}}
    told = one_row(df, ask)  # one row, two numbers for each column and probability
    some = [i for i in range(len(columns)) if told[f"n{i}"]]
    out: dict[str, list[float | None]] = {k: [None] * len(probs) for k in columns}
    if not some or not probs:
        return out
    lits = lambda i, side: F.array(*[F.lit(float(told[f"s{i}"][2 * j + side])) for j in range(len(probs))])
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), x[i].alias("_v"), F.lit(told[f"n{i}"]).alias("_n"), lits(i, 0).alias("_lo"),
                               lits(i, 1).alias("_hi")) for i in some])
    rows = df.select(F.explode(cells).alias("_x")).select("_x.*").where("_v IS NOT NULL")
    if _too_many(max(told[f"n{i}"] for i in some), len(probs)):
        near = _materialize(_narrowed(rows, ["_c"], probs))
        rows = rows.select("_c", "_v").join(F.broadcast(near), "_c")  # a row for each column
    for r in _selected(rows, ["_c"], probs).collect():  # a row for each column
        out[columns[r["_c"]]] = [r[f"q{j}"] for j in range(len(probs))]
    return out


def _grouped_quantiles(base: DataFrame, gnames: list[str], by: list[str], probs: list[float]) -> DataFrame:
    """The same selection for every group; the brackets are a table with one row for each group."""
    base = base.withColumn("_v", F.col("_v") + F.lit(0.0))
    near = base.groupBy(*gnames).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", _bracket_shares(probs), ACCURACY).alias("_s"))
    near = _materialize(near.select(*gnames, "_n", *_ends(F.col("_s"), len(probs))))
    size = near.agg(F.count(F.lit(1)).alias("groups"), F.max("_n").alias("n")).first()
    few = size["groups"] <= GROUPS_TO_BROADCAST

    def placed(state):
        return base.join(F.broadcast(state) if few else state, gnames)

    if _too_many(size["n"], len(probs)):
        near = _materialize(_narrowed(placed(near), gnames, probs))
    wide = _selected(placed(near), gnames, probs)
    return wide.select(*[F.col(g).alias(k) for g, k in zip(gnames, by)], *[f"q{j}" for j in range(len(probs))])


def _materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of the small state into the cluster's shared checkpoint folder."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mode_values(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column as text, smallest on ties (see ``heavy``)."""
    from .heavy import frequencies
    return {k: f.top[0][0] if f.top else None for k, f in frequencies(df, cols, 1).items()}
