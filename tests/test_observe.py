"""Counts observed while a chain runs: equal to direct counts, taken in one run of a row-wise chain."""

import pytest
from pyspark.sql import functions as F

from spruce.operators import validate
from spruce.plans import observe, recipe, registry

SF = "/root/testdata/sf0.001"


def direct(df, steps):
    """(rows, missing cells) of the source and after each step, each counted by itself."""
    out = []
    for i in range(len(steps) + 1):
        cur = recipe.replay(df, steps[:i])
        out.append(tuple(cur.agg(F.count(F.lit(1)), F.coalesce(F.sum(observe.missing_cells(cur)), F.lit(0))).first()))
    return out


ROW_WISE = [recipe.make_step("fill_missing", {"strategy": "median"}, ["value"]), recipe.make_step("standardize_categorical", {}, ["kind"]),
            recipe.make_step("drop_rows", {}, ["kind"]), recipe.make_step("outlier_treatment", {"action": "remove"}, ["value"]),
            recipe.make_step("create_column", {"name": "x", "formula": "value / 0"}), recipe.make_step("drop_columns", {}, ["ts"])]
ORDERED = recipe.make_step("fill_missing", {"strategy": "ffill", "order_by": "event_id"}, ["value"])
COPIES = recipe.make_step("remove_duplicates", {"subset": ["user_id", "kind"], "order_by": "event_id"})


@pytest.mark.parametrize("steps,runs", [(ROW_WISE, 1), (ROW_WISE[:3] + [COPIES] + ROW_WISE[4:], 2), ([ORDERED, COPIES], 3), ([], 1),
                                        ([recipe.make_step("convert_type", {"target": "datetime", "order_by": "event_id"}, ["kind"])], 1)])
def test_counts_equal_direct_counts(spark, steps, runs):
    df = registry.dirty_events(spark, SF)
    watch = observe.Watch(df)
    for s in steps:
        watch.step(lambda x, s=s: recipe.apply_step(x, s))
    assert watch.results() == direct(df, steps) and watch.runs == runs


def test_a_row_wise_audit_reads_the_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    base = registry.dirty_events(spark, SF).select("event_id", "kind", "value")
    df = base.mapInArrow(counted, base.schema)
    steps = [ROW_WISE[1], ROW_WISE[2], recipe.make_step("map_values", {"mapping": {"click": "c"}}, ["kind"]), ROW_WISE[4]]
    report = recipe.audit_report(df, steps).collect()
    assert seen.value == base.count() and [r.rows_after for r in report] == [x[0] for x in direct(base, steps)[1:]]


def test_places_that_the_optimizer_drops_are_counted_apart(spark):
    df = spark.range(7).withColumn("x", F.lit(None).cast("int"))
    watch = observe.Watch(df).step(lambda x: x.where(F.lit(False))).step(lambda x: x.withColumn("y", F.lit(1)))
    assert watch.results() == [(7, 7), (0, 0), (0, 0)]


def test_violations_counted_beside_their_rows(spark):
    df = registry.dirty_events(spark, SF)
    found = observe.CountedViolations(df, [r.to_dict() for r in registry._RULES], "event_id")
    rows = found.violations.collect()
    want = sorted(map(tuple, validate.violation_summary(validate.validate_rules(df, registry._RULES)).collect()))
    assert sorted(map(tuple, found.summary().collect())) == want and sum(x[2] for x in want) == len(rows)
    none = observe.CountedViolations(df, [])
    assert none.violations.collect() == [] == none.summary().collect()
