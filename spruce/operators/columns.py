"""Projections and filters: IN / range filters, rename, drop, formula columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import as_list, c, require
from ..functions.formula import compile_formula, mean_refs
from . import stats


def filter_condition(df: DataFrame, filters: dict) -> Column:
    """list/set -> IN (null only if listed); 2-tuple -> inclusive range; others ignored.

    For ``where``, which drops what is null; plain predicates reach the scan.
    """
    cond = F.lit(True)
    for name, rule in filters.items():
        if name not in df.columns:
            continue
        x = c(name)
        if isinstance(rule, (list, set, frozenset)):
            vals = [v for v in rule if v is not None]
            part = x.isin(vals) if vals else F.lit(False)
            if len(vals) != len(list(rule)):
                part = part | x.isNull()
            cond = cond & part
        elif isinstance(rule, tuple) and len(rule) == 2:
            lo, hi = rule
            cond = cond & x.between(F.lit(lo), F.lit(hi))
    return cond


def filter_dataframe(df: DataFrame, filters: dict) -> DataFrame:
    """All conditions ANDed into one ``where`` (pushed to the scan where it can be)."""
    return df.where(filter_condition(df, filters))


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """Absent names are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns and k != v})


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """P5: absent names are ignored."""
    return df.drop(*[k for k in as_list(columns) if k in df.columns])


def create_formula_column(df: DataFrame, name: str, formula: str) -> DataFrame:
    """New column from a formula (arithmetic, comparisons, log(col), col - mean(col))."""
    refs = [r for r in mean_refs(formula) if r in df.columns]
    means = stats.column_stats(df, refs, ["mean"]) if refs else {}
    expr = compile_formula(formula, list(df.columns), lambda k: means[k]["mean"] if k in means else None)
    return df.withColumn(name, expr)
