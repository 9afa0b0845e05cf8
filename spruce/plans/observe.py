"""Counts taken while a chain runs, with ``DataFrame.observe``.

``Watch`` puts named counts (rows, missing cells) at places of a chain; one run of the chain's end gives them all.  The counts
are read from the run that was asked for, not from the first one that passes by: steps that read statistics run
jobs of their own over the same chain, some of which (a top-1 probe) do not read it to the end.

A step that reads its input more than once (duplicates, fills by order) would run the places before it more than once, or in
part.  ``Watch.step`` notices that from the plan, writes the input of such a step to ``spark.checkpoint.dir``, which is itself
the run that gives the counts before it, and goes on from there.  So no stage is computed again for the sake of a count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.profile import _missing
from ..operators.validate import ValidationRule, validate_rules
from ..session import ensure_checkpoint_dir


def missing_cells(df: DataFrame) -> Column:
    """Missing cells of a row."""
    out = F.lit(0).cast("long")
    for k in df.columns:
        out = out + _missing(df, k).cast("long")
    return out


def _totals(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing_cells(df)), F.lit(0).cast("long")).alias("missing")]


class Watch:
    """Rows and missing cells at places of one chain."""

    def __init__(self, source: DataFrame):
        self.counts: list[tuple[int, int] | None] = []
        self.columns: list[list[str]] = []
        self._open: dict[str, tuple[int, DataFrame]] = {}  # by name: places that no run has counted yet
        self.runs = 0
        self.current = self._place(source)

    def _place(self, df: DataFrame) -> DataFrame:
        name = f"spruce_{uuid.uuid4().hex}"
        self._open[name] = (len(self.counts), df)
        self.counts.append(None)
        self.columns.append(list(df.columns))
        return df.observe(name, *_totals(df))

    def _read(self, run: DataFrame) -> None:
        """Take the open places' counts from a frame that has just been run."""
        self.runs += 1
        metrics = run._jdf.queryExecution().observedMetrics()
        for name, (at, df) in self._open.items():
            if metrics.contains(name):
                row = metrics.apply(name)
                self.counts[at] = (row.getLong(0), row.getLong(1))
            else:  # the optimizer has found that nothing below is needed, so nothing has run there
                self.counts[at] = tuple(df.agg(*_totals(df)).first())
        self._open = {}

    def step(self, apply: Callable[[DataFrame], DataFrame]) -> "Watch":
        before = self.current
        after = apply(before)
        plan = after._jdf.queryExecution().analyzed().toString()
        if any(plan.count(f"CollectMetrics {name}") != 1 for name in self._open):
            ensure_checkpoint_dir(before.sparkSession)
            fixed = before.checkpoint(eager=True)
            self._read(before)
            after = apply(fixed)
        self.current = self._place(after)
        return self

    def results(self) -> list[tuple[int, int]]:
        """(rows, missing cells) of the source and after each step."""
        if self._open:
            end = self.current.groupBy().count()
            end.collect()
            self._read(end)
        return list(self.counts)


def before_after_nulls(source: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """F10 of a change that is yet to be made: (stage, rows, missing_cells) of both sides from one run of it."""
    before, after = Watch(source).step(transform).results()
    return source.sparkSession.createDataFrame([("before", *before), ("after", *after)], "stage string, rows long, missing_cells long")


class CountedViolations:
    """V5 beside V1 to V4: ``violations`` are the rows of ``validate_rules``; once they have been written or read, ``summary`` has
    their numbers without another scan."""

    def __init__(self, df: DataFrame, rules, key_cols=None):
        rules = [r if isinstance(r, ValidationRule) else ValidationRule.from_dict(r) for r in rules]
        self._kinds = list(dict.fromkeys((r.column, r.rule_type) for r in rules if r.column in df.columns))
        self._spark = df.sparkSession
        self._seen = Observation()
        found = validate_rules(df, rules, key_cols)
        counts = [F.count_if((F.col("column") == k) & (F.col("rule_type") == t)).alias(f"n{i}") for i, (k, t) in enumerate(self._kinds)]
        self.violations = found.observe(self._seen, *counts) if counts else found

    def summary(self) -> DataFrame:
        """(column, rule_type, violations), of kinds that occur; waits for a run of ``violations``."""
        seen = self._seen.get if self._kinds else {}
        rows = [(k, t, seen[f"n{i}"]) for i, (k, t) in enumerate(self._kinds) if seen[f"n{i}"]]
        return self._spark.createDataFrame(rows, "`column` string, rule_type string, violations long")
