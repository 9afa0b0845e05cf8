"""Chart-ready aggregates: histograms, box statistics, scatter/line series, bars, correlations.

Each function returns the small table a chart is drawn from; drawing is
outside this library.  All group-bys are single aggregates (map-side
combine), per-group statistics come from one grouped job, never from a
filter per group.

Bins are over the finite values.  Infinities are no reason to lose the others, nor are they lost:
they are counted in bins of their own, -1 for the negative and ``bins`` for the positive one, which exist only where there is one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import as_double, as_list, c, categorical_columns, is_numeric, numeric_columns, require
from . import stats
from .categorical import distinct_within

def _bin_index(x: Column, mn: Column, mx: Column, n: int) -> Column:
    """numpy.histogram's bin of x over n equal bins of [mn, mx] (last bin closed)."""
    step = (mx - mn) / F.lit(float(n))
    norm = F.lit(float(n)) / (mx - mn)

    def edge(k: Column) -> Column:
        return F.when(k >= n, mx).otherwise(k.cast("double") * step + mn)

    i0 = F.least(F.floor((x - mn) * norm).cast("int"), F.lit(n - 1))
    i1 = i0 - F.when(x < edge(i0), 1).otherwise(0)
    i2 = i1 + F.when((x >= edge(i1 + 1)) & (i1 != n - 1), 1).otherwise(0)
    return i2


def _outer_bin(x: Column, inner: Column, n: int) -> Column:
    """``inner`` for finite x, -1 and n for the infinities."""
    return F.when(x == F.lit(float("inf")), F.lit(n)).when(x == F.lit(float("-inf")), F.lit(-1)).otherwise(inner)


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def _edges(b: Column, n: int, mn: Column, mx: Column) -> tuple[Column, Column]:
    """(start, end) of a bin; both are the infinity for the outer ones."""
    step = (mx - mn) / F.lit(float(n))
    start = b.cast("double") * step + mn
    end = F.when(b == n - 1, mx).otherwise((b + 1).cast("double") * step + mn)
    outer = F.when(b < 0, F.lit(float("-inf"))).when(b >= n, F.lit(float("inf")))
    return F.coalesce(outer, start).alias("bin_start"), F.coalesce(outer, end).alias("bin_end")


def _hist_range(mn, mx):
    if mn == mx:
        return mn - 0.5, mx + 0.5
    return mn, mx


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """H1: (bin, bin_start, bin_end, count) over [min, max] of the finite values."""
    require(df, [column])
    x = as_double(column)
    st = stats.one_row(df, {"min": F.min(_finite(x)), "max": F.max(_finite(x))})
    spark = df.sparkSession
    some = st["min"] is not None
    mn, mx = _hist_range(st["min"], st["max"]) if some else (0.0, 1.0)
    counts = df.where(x.isNotNull()).groupBy(_outer_bin(x, _bin_index(x, F.lit(mn), F.lit(mx), bins), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    # a zero for every bin, so that empty bins are there too
    zeros = spark.range(bins if some else 0).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("count"))
    out = counts.unionByName(zeros).groupBy("bin").agg(F.sum("count").alias("count"))
    return out.select("bin", *_edges(F.col("bin"), bins, F.lit(mn), F.lit(mx)), "count")


def histogram_grouped(df: DataFrame, column: str, group: str, bins: int = 30) -> DataFrame:
    """H2: one histogram per non-null group value, each over its own [min, max] of finite values."""
    require(df, [column, group])
    x = as_double(column)
    rows = df.select(c(group).alias("group"), x.alias("_x")).where(
        F.col("group").isNotNull() & F.col("_x").isNotNull())
    g = rows.groupBy("group").agg(F.min(_finite(F.col("_x"))).alias("_mn0"), F.max(_finite(F.col("_x"))).alias("_mx0"))
    g = g.select("group",
                 F.when(F.col("_mn0") == F.col("_mx0"), F.col("_mn0") - 0.5).otherwise(F.col("_mn0")).alias("_mn"),
                 F.when(F.col("_mn0") == F.col("_mx0"), F.col("_mx0") + 0.5).otherwise(F.col("_mx0")).alias("_mx"))
    j = rows.join(g, "group")
    inner = _bin_index(F.col("_x"), F.col("_mn"), F.col("_mx"), bins)
    counts = j.groupBy("group", _outer_bin(F.col("_x"), inner, bins).alias("bin"), "_mn", "_mx").agg(F.count(F.lit(1)).alias("count"))
    # every group gets all its bins: the group table (one row per group) is
    # expanded to bins, not joined against the rows
    zeros = g.where("_mn IS NOT NULL").select("group", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_mn", "_mx",
                                              F.lit(0).cast("long").alias("count"))
    out = counts.unionByName(zeros).groupBy("group", "bin", "_mn", "_mx").agg(F.sum("count").alias("count"))
    return out.select("group", "bin", *_edges(F.col("bin"), bins, F.col("_mn"), F.col("_mx")), "count")


def _fence(q1: float, q3: float, whisker: float) -> tuple[float, float]:
    """Where infinite quartiles leave a fence undefined it fences nothing."""
    lo, hi = q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1)
    return float("-inf") if lo != lo else lo, float("inf") if hi != hi else hi


def _fence_column(q1: str, q3: str, whisker: float) -> Column:
    at = F.col(q1 if whisker < 0 else q3) + whisker * (F.col(q3) - F.col(q1))
    return F.when(F.isnan(at), F.lit(float("-inf") if whisker < 0 else float("inf"))).otherwise(at)


def box_stats(df: DataFrame, column: str, group: str | None = None, whisker: float = 1.5,
              exact: bool = True) -> DataFrame:
    """H3: q1, median, q3, whiskers (furthest values within whisker*IQR), outlier count, count."""
    by = [group] if group else []
    require(df, [column] + by)
    x = as_double(column)
    rows = df.select(*[c(k).alias(k) for k in by], x.alias("_x")).where(F.col("_x").isNotNull())
    for k in by:
        rows = rows.where(c(k).isNotNull())
    if not by:
        q1, med, q3 = stats.quantiles(df, column, [0.25, 0.5, 0.75], exact=exact)
        if q1 is None:
            q1 = med = q3 = lo = hi = None
        else:
            lo, hi = _fence(q1, q3, whisker)
        j = rows.select("_x", F.lit(q1).cast("double").alias("q1"), F.lit(med).cast("double").alias("median"),
                        F.lit(q3).cast("double").alias("q3"), F.lit(lo).cast("double").alias("_lo"),
                        F.lit(hi).cast("double").alias("_hi"))
    else:
        q = stats.quantile_table(df, column, [0.25, 0.5, 0.75], by=by, exact=exact)
        q = q.select(*by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
        q = q.withColumns({"_lo": _fence_column("q1", "q3", -whisker), "_hi": _fence_column("q1", "q3", whisker)})
        j = rows.join(q, by, "inner")
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    return j.groupBy(*[c(k) for k in by], "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("count"))


def box_outliers(df: DataFrame, column: str, group: str | None = None, whisker: float = 1.5,
                 exact: bool = True) -> DataFrame:
    """H3: the outlier points (beyond the whisker fences), per group."""
    by = [group] if group else []
    require(df, [column] + by)
    x = as_double(column)
    rows = df.select(*[c(k).alias(k) for k in by], x.alias("value")).where(F.col("value").isNotNull())
    for k in by:
        rows = rows.where(c(k).isNotNull())
    if not by:
        q1, q3 = stats.quantiles(df, column, [0.25, 0.75], exact=exact)
        if q1 is None:
            return rows.limit(0)
        lo, hi = _fence(q1, q3, whisker)
        return rows.where((F.col("value") < F.lit(lo)) | (F.col("value") > F.lit(hi)))
    q = stats.quantile_table(df, column, [0.25, 0.75], by=by, exact=exact)
    q = q.select(*by, _fence_column("q0", "q1", -whisker).alias("_lo"), _fence_column("q0", "q1", whisker).alias("_hi"))
    j = rows.join(q, by, "inner")
    return j.where((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi"))).select(*by, "value")


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """H4: (x, y[, color]), every point; with a colour, rows without one are dropped.

    For more points than can be drawn see ``scatter_bins``.
    """
    cols = [x, y] + ([color] if color else [])
    require(df, cols)
    out = df.select(*[c(k) for k in cols])
    if color:
        out = out.where(c(color).isNotNull())
    return out


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """H4 for large tables: (x_bin, y_bin, count) over ``bins`` equal bins of each axis; every point with both values counts."""
    require(df, [x, y])
    rows = df.select(as_double(x).alias("_x"), as_double(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    ends = rows.agg(*[f(_finite(F.col(k))) for k in ("_x", "_y") for f in (F.min, F.max)]).first()

    def bin_of(k, mn, mx):
        mn, mx = (0.0, 1.0) if mn is None else _hist_range(mn, mx)
        return _outer_bin(F.col(k), _bin_index(F.col(k), F.lit(mn), F.lit(mx), bins), bins)

    return rows.groupBy(bin_of("_x", ends[0], ends[1]).alias("x_bin"), bin_of("_y", ends[2], ends[3]).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("count"))


def line_series(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """H5: (x, y[, color]) sorted by x, missing x last (per colour when given)."""
    cols = [x, y] + ([color] if color else [])
    require(df, cols)
    out = df.select(*[c(k) for k in cols])
    if color:
        out = out.where(c(color).isNotNull())
        return out.orderBy(c(color), c(x).asc_nulls_last())
    return out.orderBy(c(x).asc_nulls_last())


def _agg(y: str, how: str) -> Column:
    v = as_double(y)
    how = how.lower()
    if how == "mean":
        return F.avg(v)
    if how == "sum":
        return F.coalesce(F.sum(v), F.lit(0.0))
    if how == "count":
        return F.count(c(y))
    if how in ("min", "max"):
        return F.min(v) if how == "min" else F.max(v)
    raise ValueError(f"unknown aggregate {how!r}")


def _grouped_value(df: DataFrame, keys: list[str], y: str, how: str, exact: bool = True) -> DataFrame:
    rows = df
    for k in keys:
        rows = rows.where(c(k).isNotNull())
    if how.lower() == "median":
        found = stats.quantile_table(rows, y, [0.5], by=keys, exact=exact).withColumnRenamed("q0", "value")
        return rows.select(*[c(k) for k in keys]).distinct().join(found, keys, "left")  # groups without a value stay
    value = _agg(y, how)
    if how.lower() == "count" and isinstance(df.schema[y].dataType, (T.DoubleType, T.FloatType)):
        value = F.count(as_double(y))  # NaN is missing
    return rows.groupBy(*[c(k) for k in keys]).agg(value.alias("value"))


def bar_aggregate(df: DataFrame, x: str, y: str, agg: str = "mean", top_n: int | None = None,
                  exact: bool = True) -> DataFrame:
    """H6: value per non-null x (mean, sum, count, median); top n by value (ties: smallest x)."""
    require(df, [x, y])
    g = _grouped_value(df, [x], y, agg, exact)
    if top_n:
        return g.orderBy(F.col("value").desc_nulls_last(), c(x)).limit(top_n)
    return g


def bar_grouped_long(df: DataFrame, x: str, y: str, color: str, agg: str = "mean",
                     top_n: int | None = None, exact: bool = True) -> DataFrame:
    """Value per (x, color), long form; x limited to the top n by total of its values."""
    require(df, [x, y, color])
    g = _grouped_value(df, [x, color], y, agg, exact)
    if not top_n:
        return g
    top = g.groupBy(c(x)).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("_t")) \
        .orderBy(F.col("_t").desc(), c(x)).limit(top_n).select(c(x))
    return g.join(F.broadcast(top), x, "left_semi")  # top holds at most top_n rows


def bar_grouped_wide(df: DataFrame, x: str, y: str, color: str, agg: str = "mean",
                     top_n: int | None = None, exact: bool = True, max_values: int | None = 10_000) -> DataFrame:
    """H7: one row per x, one column per colour value (pivot); top n x by row total.

    More than ``max_values`` colours (10,000 unless given; None is no limit) are an error before any is collected.
    """
    long = bar_grouped_long(df, x, y, color, agg, top_n, exact)
    # every colour of the table is a column, also where the top n have no row of it
    values = distinct_within(df.where(c(x).isNotNull() & c(color).isNotNull()), [color], max_values)[color]
    wide = long.groupBy(c(x)).pivot(color, values).agg(F.first("value"))
    return wide


GRAM_COLUMNS = 40
GRAM_LIMIT = 2_000  # columns; a task holds four matrices of that width


def _gram(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise complete correlations of many columns from sums of products.

    With X the values (0 where missing, moved by the column's mean) and M the mask of what is there, the sums over the rows that
    hold both columns of a pair are the cells of M'M, X'M, (X*X)'M and X'X.  Every task adds up its rows' products a batch at a
    time; the tasks' matrices are summed by one map-side combined aggregate on the pair.
    """
    import numpy as np
    import pandas as pd
    if len(cols) > GRAM_LIMIT:
        raise ValueError(f"correlations of more than {GRAM_LIMIT} columns at once")
    d = len(cols)
    mean = stats.column_stats(df, cols, ["mean"])
    shift = np.array([mean[k]["mean"] if mean[k]["mean"] is not None and abs(mean[k]["mean"]) < float("inf") else 0.0 for k in cols])

    def products(batches):
        sums = np.zeros((4, d, d))
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d)], axis=1).astype(float) - shift
            m = ~np.isnan(x)
            x[~m] = 0.0
            m = m.astype(float)
            sums += [m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x]
        i, j = np.triu_indices(d)
        out = pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": sums[0][i, j], "a": sums[1][i, j], "b": sums[1][j, i],
                            "aa": sums[2][i, j], "bb": sums[2][j, i], "ab": sums[3][i, j]})
        import pyarrow as pa
        yield pa.RecordBatch.from_pandas(out[out["n"] > 0], preserve_index=False)

    rows = df.select(*[as_double(k).alias(f"c{i}") for i, k in enumerate(cols)])
    sums = rows.mapInArrow(products, "i int, j int, n double, a double, b double, aa double, bb double, ab double").groupBy("i", "j").agg(
        *[F.sum(k).alias(k) for k in ("n", "a", "b", "aa", "bb", "ab")])
    n = F.col("n")
    va, vb = F.col("aa") / n - F.pow(F.col("a") / n, 2), F.col("bb") / n - F.pow(F.col("b") / n, 2)
    tiny = 1e-12  # what rounding leaves of a constant column's variance, as a share of its mean square
    flat = (va <= tiny * F.col("aa") / n) | (vb <= tiny * F.col("bb") / n)
    r = F.when(~flat, (F.col("ab") / n - F.col("a") / n * F.col("b") / n) / F.sqrt(va * vb))
    names = F.array(*[F.lit(k) for k in cols])
    name = lambda k: F.element_at(names, F.col(k) + 1)
    every = df.sparkSession.range(d * d).select((F.col("id") / d).cast("int").alias("p"), (F.col("id") % d).cast("int").alias("q"))
    known = sums.select("i", "j", F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("corr"))
    low, high = F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")
    both = every.select("p", "q", low, high).join(known, ["i", "j"], "left")  # a pair without common rows is null
    return both.select(name("p").alias("col_a"), name("q").alias("col_b"), "corr")


def correlation_matrix(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """H8: Pearson correlation of every pair of numeric columns, pairwise complete, long form.

    All pairs come from one aggregate; of more than ``GRAM_COLUMNS`` columns from a Gram matrix (see ``_gram``), as an aggregate of
    that many expressions would not compile.  A constant column gives null (Spark's ``corr`` would divide by zero under ANSI).
    """
    cols = as_list(columns) if columns is not None else numeric_columns(df)
    cols = [k for k in require(df, cols) if is_numeric(df.schema[k].dataType)]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "col_a string, col_b string, corr double")
    if len(cols) > GRAM_COLUMNS:
        return _gram(df, cols)
    aggs = []
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            xa, xb = as_double(a), as_double(b)
            both = xa.isNotNull() & xb.isNotNull()
            pa, pb = F.when(both, xa), F.when(both, xb)
            r = F.try_divide(F.covar_pop(pa, pb), F.stddev_pop(pa) * F.stddev_pop(pb))
            aggs.append(r.alias(f"_r{i}_{j}"))
            pairs.append((i, j))
    one = df.agg(*aggs)
    items = []
    for i, j in pairs:
        items.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                              F.col(f"_r{i}_{j}").alias("corr")))
        if i != j:
            items.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"),
                                  F.col(f"_r{i}_{j}").alias("corr")))
    return one.select(F.explode(F.array(*items)).alias("_p")).select("_p.*")


def filter_domains(df: DataFrame, max_categorical: int = 8, max_numeric: int = 6) -> DataFrame:
    """H9: filter widgets' choices: distinct values of the first text columns,
    [min, max] of the first numeric columns (skipped when min = max)."""
    cats = categorical_columns(df)[:max_categorical]
    nums = numeric_columns(df)[:max_numeric]
    parts = []
    if cats:  # all text columns in one scan
        cells = F.array(*[F.struct(F.lit(k).alias("column"), c(k).cast("string").alias("value")) for k in cats])
        values = df.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("value").isNotNull()).distinct()
        parts.append(values.select("column", F.lit("values").alias("kind"), "value", F.lit(None).cast("double").alias("min"),
                                   F.lit(None).cast("double").alias("max")))
    if nums:
        one = df.agg(*[F.min(as_double(k)).alias(f"_lo{i}") for i, k in enumerate(nums)],
                     *[F.max(as_double(k)).alias(f"_hi{i}") for i, k in enumerate(nums)])
        items = [F.struct(F.lit(k).alias("column"), F.lit("range").alias("kind"),
                          F.lit(None).cast("string").alias("value"), F.col(f"_lo{i}").alias("min"),
                          F.col(f"_hi{i}").alias("max")) for i, k in enumerate(nums)]
        rng = one.select(F.explode(F.array(*items)).alias("_r")).select("_r.*") \
            .where(F.col("min") != F.col("max"))
        parts.append(rng)
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "column string, kind string, value string, min double, max double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
