"""Validation rules: every violation as a row, from one scan of the table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import as_list, c, require
from ..functions.text import to_double_coerce

VIOLATION_FIELDS = ["column", "rule_type", "value", "detail"]


@dataclass
class ValidationRule:
    """V6: ``rule_type`` is 'range' {min, max}, 'allowed' {values} or 'non_null'."""
    rule_type: str
    column: str
    params: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"rule_type": self.rule_type, "column": self.column, "params": dict(self.params)}

    @classmethod
    def from_dict(cls, d: dict) -> "ValidationRule":
        return cls(d["rule_type"], d["column"], dict(d.get("params") or {}))


def _num_text(v) -> str:
    """A bound as Python prints it (so details read 'Below minimum (0)')."""
    return str(v)


def _violations(df: DataFrame, rule: ValidationRule) -> list[Column]:
    """Struct-or-null expressions, one per kind of violation of this rule."""
    k = rule.column
    x = c(k)
    text = x.cast("string")
    out = []
    if rule.rule_type == "range":
        num = x.cast("double") if isinstance(df.schema[k].dataType, T.NumericType) else to_double_coerce(x)
        num = F.when(~F.isnan(num), num)  # NaN is a missing value, no violation
        lo, hi = rule.params.get("min"), rule.params.get("max")
        if lo is not None:
            out.append(F.when(num < F.lit(float(lo)), F.struct(
                F.lit(k).alias("column"), F.lit("range").alias("rule_type"), text.alias("value"),
                F.lit(f"Below minimum ({_num_text(lo)})").alias("detail"))))
        if hi is not None:
            out.append(F.when(num > F.lit(float(hi)), F.struct(
                F.lit(k).alias("column"), F.lit("range").alias("rule_type"), text.alias("value"),
                F.lit(f"Above maximum ({_num_text(hi)})").alias("detail"))))
    elif rule.rule_type == "allowed":
        vals = list(rule.params.get("values") or [])
        if vals:
            dt = df.schema[k].dataType
            typed = [F.lit(v).try_cast(dt) if not isinstance(dt, T.StringType) else F.lit(str(v)) for v in vals]
            there = x.isNotNull()
            if isinstance(dt, (T.DoubleType, T.FloatType)):
                there = there & ~F.isnan(x)
            out.append(F.when(there & ~F.coalesce(x.isin(*typed), F.lit(False)), F.struct(
                F.lit(k).alias("column"), F.lit("allowed").alias("rule_type"), text.alias("value"),
                F.lit(f"Not in allowed values: {vals}").alias("detail"))))
    elif rule.rule_type == "non_null":
        miss = x.isNull()
        if isinstance(df.schema[k].dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(x)
        out.append(F.when(miss, F.struct(
            F.lit(k).alias("column"), F.lit("non_null").alias("rule_type"), F.lit("NaN").alias("value"),
            F.lit("Null value found").alias("detail"))))
    return out


def validate_rules(df: DataFrame, rules: Iterable[ValidationRule | dict], key_cols=None) -> DataFrame:
    """V1-V4: (key columns..., column, rule_type, value, detail), one row per violation.

    All rules are checked in one pass: each row builds an array of its
    violations and ``explode`` emits them.  Rules on unknown columns or of
    unknown type are skipped; no violations -> an empty frame, same schema.
    """
    keys = require(df, as_list(key_cols))
    checks: list[Column] = []
    for r in rules:
        rule = r if isinstance(r, ValidationRule) else ValidationRule.from_dict(r)
        if rule.column not in df.columns:
            continue
        checks.extend(_violations(df, rule))
    schema = "column string, rule_type string, value string, detail string"
    if not checks:
        empty = F.array().cast(f"array<struct<{schema.replace(' string', ': string')}>>")
        arr = empty
    else:
        arr = F.filter(F.array(*checks), lambda v: v.isNotNull())
    exploded = df.select(*[c(k) for k in keys], F.explode(arr).alias("_v"))
    return exploded.select(*[c(k) for k in keys], *[F.col(f"_v.{f}").alias(f) for f in VIOLATION_FIELDS])


def violation_summary(violations: DataFrame) -> DataFrame:
    """V5: number of violations per column and rule."""
    return violations.groupBy("column", "rule_type").agg(F.count(F.lit(1)).alias("violations"))
