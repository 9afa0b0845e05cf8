"""Recipes on streaming DataFrames.

The reference has no streams.  What carries over is a property: steps that
need no statistics of the whole table are row-wise and run unchanged on a
streaming DataFrame.  Steps that need table statistics (means, quantiles,
distinct values, duplicates) are refused here instead of silently computing
them per micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..plans.recipe import apply_step

# Steps whose output row depends only on the input row.
ROW_WISE = {"standardize_categorical", "drop_columns", "rename_column", "map_values", "drop_rows"}
ROW_WISE_CONVERSIONS = {"numeric", "numeric (dirty)", "dirty_numeric", "datetime (mixed)", "datetime_mixed",
                        "categorical"}


def is_row_wise(step: dict) -> bool:
    op = step.get("operation")
    p = step.get("params") or {}
    if op in ROW_WISE:
        return True
    if op == "convert_type":
        t = str(p.get("target", "numeric")).lower()
        return t in ROW_WISE_CONVERSIONS or (t == "datetime" and p.get("format"))
    if op == "fill_missing":
        return str(p.get("strategy", "")).lower() == "constant"
    if op == "create_column":
        return "mean(" not in str(p.get("formula", ""))
    return False


def apply_to_stream(stream: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """Apply row-wise recipe steps to a streaming DataFrame."""
    bad = [s.get("operation") for s in steps if not is_row_wise(s)]
    if bad:
        raise ValueError(f"steps need whole-table statistics and cannot run on a stream: {bad}")
    out = stream
    for s in steps:
        out = apply_step(out, s)
    return out
