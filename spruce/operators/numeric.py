"""Numeric cleaning: outlier statistics and flags, capping, removal, scaling, binning."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import as_double, as_list, c, require
from . import stats


def iqr_bounds(df: DataFrame, column: str, factor: float = 1.5, exact: bool = True) -> dict:
    return _iqr(*stats.quantiles(df, column, [0.25, 0.75], exact=exact), factor)


def _iqr(q1: float | None, q3: float | None, factor: float) -> dict:
    if q1 is None:
        return {"q1": None, "q3": None, "iqr": None, "lower": None, "upper": None}
    iqr = q3 - q1
    return {"q1": q1, "q3": q3, "iqr": iqr, "lower": _bound(q1 - factor * iqr), "upper": _bound(q3 + factor * iqr)}


def _bound(x: float) -> float | None:
    """None for NaN: a bound that infinities leave undefined bounds nothing (Spark holds every value to be below NaN)."""
    return None if math.isnan(x) else x


def zscore_bounds(df: DataFrame, column: str, threshold: float = 3.0) -> dict:
    st = stats.column_stats(df, [column], ["mean", "std"])[column]
    return _zscore(st["mean"], st["std"], threshold)


def _zscore(mean: float | None, std: float | None, threshold: float) -> dict:
    lower = upper = None
    if std is not None and math.isnan(std):
        std = None  # an infinity among the values: no z-score is defined, so nothing is flagged or capped
    if mean is not None and std is not None:
        lower, upper = _bound(mean - threshold * std), _bound(mean + threshold * std)
    return {"mean": mean, "std": std, "threshold": threshold, "lower": lower, "upper": upper}


def iqr_mask(column: str, b: dict) -> Column:
    """Outside [lower, upper]; null value -> false."""
    x = as_double(column)
    low = F.lit(False) if b["lower"] is None else x < F.lit(b["lower"])
    high = F.lit(False) if b["upper"] is None else x > F.lit(b["upper"])
    return F.coalesce(low | high, F.lit(False))


def zscore_mask(column: str, b: dict) -> Column:
    """|z| > threshold; std 0 or undefined (one value, or an infinity among them) -> false."""
    if b["std"] is None or b["std"] == 0 or b["mean"] is None or not math.isfinite(b["mean"]):
        return F.lit(False)
    z = F.abs((as_double(column) - F.lit(b["mean"])) / F.lit(b["std"]))
    return F.coalesce(z > F.lit(b["threshold"]), F.lit(False))


def _mask_summary(df: DataFrame, mask: Column) -> DataFrame:
    one = df.agg(F.count_if(mask).alias("count"), F.count(F.lit(1)).alias("_rows"))
    return one.select("count", F.round(F.try_divide(F.col("count").cast("double"),
                                                     F.col("_rows").cast("double")) * 100, 2).alias("pct"))


def detect_outliers_iqr(df: DataFrame, column: str, factor: float = 1.5, exact: bool = True) -> DataFrame:
    """q1, q3, iqr, lower, upper (4 dp), count, pct (2 dp, of all rows)."""
    require(df, [column])
    b = iqr_bounds(df, column, factor, exact)
    s = _mask_summary(df, iqr_mask(column, b))
    lit4 = {k: F.round(F.lit(b[k]).cast("double"), 4).alias(k) for k in ("q1", "q3", "iqr", "lower", "upper")}
    return s.select(*lit4.values(), "count", "pct")


def detect_outliers_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Mean, std (4 dp; null where undefined), threshold, count, pct."""
    require(df, [column])
    b = zscore_bounds(df, column, threshold)
    s = _mask_summary(df, zscore_mask(column, b))
    return s.select(F.round(F.lit(b["mean"]).cast("double"), 4).alias("mean"),
                    F.round(F.lit(b["std"]).cast("double"), 4).alias("std"),
                    F.lit(float(threshold)).alias("threshold"), "count", "pct")


def flag_outliers(df: DataFrame, column: str, method: str = "iqr", factor: float = 1.5,
                  threshold: float = 3.0, flag: str = "is_outlier") -> DataFrame:
    """N3 as a column."""
    m = _mask(df, column, method, factor, threshold)
    return df.withColumn(flag, m)


def _mask(df, column, method, factor, threshold) -> Column:
    if method.lower() == "iqr":
        return iqr_mask(column, iqr_bounds(df, column, factor))
    return zscore_mask(column, zscore_bounds(df, column, threshold))


def cap_outliers(df: DataFrame, column: str, lower: float | None, upper: float | None) -> DataFrame:
    """Clip into [lower, upper]; null stays null (Spark's least/greatest skip nulls)."""
    require(df, [column])
    x = as_double(column)
    y = x
    if lower is not None:
        y = F.greatest(y, F.lit(float(lower)))
    if upper is not None:
        y = F.least(y, F.lit(float(upper)))
    return df.withColumn(column, F.when(x.isNull(), F.lit(None).cast("double")).otherwise(y))


def cap_outliers_iqr(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    b = iqr_bounds(df, column, factor)
    return cap_outliers(df, column, b["lower"], b["upper"])


def cap_outliers_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Clip to mean +- threshold * std."""
    b = zscore_bounds(df, column, threshold)
    return cap_outliers(df, column, b["lower"], b["upper"])


def remove_outlier_rows(df: DataFrame, column: str, method: str = "iqr", factor: float = 1.5,
                        threshold: float = 3.0) -> DataFrame:
    """Drop rows flagged as outliers; rows with a null value are kept."""
    return df.where(~_mask(df, column, method, factor, threshold))


def treat_outliers(df: DataFrame, columns: Iterable[str], method: str = "IQR", action: str = "Cap",
                   factor: float = 1.5, threshold: float = 3.0) -> DataFrame:
    """The recipe's ``outlier_treatment`` step: cap or remove, per column in turn.

    Capping changes no other column, so the bounds of all columns come from one shared fit; rows that a column removes
    count no more for the next one, so removal fits column after column.
    """
    cols = require(df, list(dict.fromkeys(as_list(columns))))
    if "cap" not in action.lower():
        for k in cols:
            df = remove_outlier_rows(df, k, method, factor, threshold)
        return df
    if method.lower() == "iqr":
        quartiles = stats.column_quantiles(df, cols, [0.25, 0.75])
        bounds = {k: _iqr(*quartiles[k], factor) for k in cols}
    else:
        fitted = stats.column_stats(df, cols, ["mean", "std"])
        bounds = {k: _zscore(fitted[k]["mean"], fitted[k]["std"], threshold) for k in cols}
    for k in cols:
        df = cap_outliers(df, k, bounds[k]["lower"], bounds[k]["upper"])
    return df


def min_max_scale(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0.0 in every row."""
    cols = require(df, as_list(columns))
    st = stats.column_stats(df, cols, ["min", "max"])
    new = {}
    for k in cols:
        mn, mx = st[k]["min"], st[k]["max"]
        if mn is None:
            new[k] = F.lit(None).cast("double")
        elif mx - mn == 0:
            new[k] = F.lit(0.0)
        else:
            new[k] = (as_double(k) - F.lit(mn)) / F.lit(mx - mn)
    return df.withColumns(new)


def z_score_scale(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(x - mean) / sample std; std 0 -> 0.0 everywhere; one value -> null."""
    cols = require(df, as_list(columns))
    st = stats.column_stats(df, cols, ["mean", "std"])
    new = {}
    for k in cols:
        mean, std = st[k]["mean"], st[k]["std"]
        if std is not None and std == 0:
            new[k] = F.lit(0.0)
        elif mean is None or std is None:
            new[k] = F.lit(None).cast("double")
        else:
            new[k] = (as_double(k) - F.lit(mean)) / F.lit(std)
    return df.withColumns(new)


def _bin_expr(x: Column, inner_edges: Sequence[float], labels: Sequence[str] | None) -> Column:
    idx = F.lit(1) + F.size(F.filter(F.array(*[F.lit(float(e)) for e in inner_edges]), lambda e: e < x))
    out = F.when(x.isNotNull(), idx)
    if labels:
        out = F.element_at(F.array(*[F.lit(str(v)) for v in labels]), out)
    return out


def _edge_text(e: float) -> str:
    """3 decimals; below 1 in size, 3 digits."""
    if e == 0 or not math.isfinite(e) or abs(e) >= 1:
        return repr(round(e, 3))
    return repr(round(e, 2 - math.floor(math.log10(abs(e)))))


def equal_width_edges(mn: float, mx: float, n: int) -> list[float]:
    """Edges as pandas.cut builds them (numpy linspace; constant range widened)."""
    if mn == mx:
        mn = mn - (0.001 * abs(mn) if mn != 0 else 0.001)
        mx = mx + (0.001 * abs(mx) if mx != 0 else 0.001)
        edges = _linspace(mn, mx, n + 1)
    else:
        edges = _linspace(mn, mx, n + 1)
        edges[0] -= (mx - mn) * 0.001
    return edges


def _linspace(a: float, b: float, num: int) -> list[float]:
    step = (b - a) / (num - 1)
    out = [k * step + a for k in range(num)]
    out[-1] = b
    return out


def bin_column(df: DataFrame, column: str, n_bins: int, method: str = "equal_width",
               labels: Sequence[str] | None = None, exact: bool = True, intervals: bool = False) -> DataFrame:
    """``{column}_binned`` = bin number 1..n (or its label).

    With ``intervals`` (and no labels) ``{column}_interval`` is added: the bin's edges as
    text ``(lo, hi]`` as pandas prints them (3 decimals; the first lower edge is below the
    lowest value by 0.1 % of the range or, for quantiles, 0.001).

    Equal width: right-closed bins over [min, max], which must be finite (ValueError); quantile: edges at
    quantiles k/n, duplicate edges dropped, lowest value in bin 1, fewer than
    two distinct edges -> null.
    """
    require(df, [column])
    if n_bins < 1:
        raise ValueError("n_bins must be positive")
    x = as_double(column)
    new = f"{column}_binned"
    if method == "equal_width":
        st = stats.column_stats(df, [column], ["min", "max"])[column]
        if st["min"] is None:
            return df.withColumn(new, F.lit(None).cast("string" if labels else "int"))
        if not (math.isfinite(st["min"]) and math.isfinite(st["max"])):
            raise ValueError(f"Binning failed for '{column}': equal-width bins need finite values, and it holds an infinity")
        edges = equal_width_edges(st["min"], st["max"], n_bins)
    else:
        probs = [k * (1.0 / n_bins) for k in range(n_bins)] + [1.0]
        qs = stats.quantiles(df, column, probs, exact=exact)
        edges = sorted(set(q for q in qs if q is not None and not math.isnan(q)))
        if len(edges) < 2:
            return df.withColumn(new, F.lit(None).cast("string" if labels else "int"))
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError(f"Binning failed for '{column}': need {len(edges) - 1} labels")
    out = df.withColumn(new, _bin_expr(x, edges[1:-1], labels))
    if intervals and labels is None:
        low = edges[0] if method == "equal_width" else edges[0] - 0.001  # equal_width_edges has widened it
        ends = [_edge_text(float(e)) for e in [low, *edges[1:]]]
        texts = [f"({a}, {b}]" for a, b in zip(ends, ends[1:])]
        out = out.withColumn(f"{column}_interval", F.element_at(F.array(*[F.lit(t) for t in texts]), c(new).cast("int")))
    return out
