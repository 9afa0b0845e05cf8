"""Results do not depend on how the input is partitioned."""

import pytest

from spruce.operators import dedup, missing, profile, stats

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_partitioning_invariance(spark, parts):
    ev = spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "event_id", "user_id", "event_type", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value")
    df = ev.repartition(parts)
    base = ev.coalesce(1)
    assert stats.quantiles(df, "value", [0.1, 0.5, 0.9]) == stats.quantiles(base, "value", [0.1, 0.5, 0.9])

    def rows(d):
        return sorted(tuple(r) for r in d.collect())

    assert rows(dedup.remove_duplicates(df, ["user_id"], "first", order_by="event_id")) == \
        rows(dedup.remove_duplicates(base, ["user_id"], "first", order_by="event_id"))
    assert rows(missing.fill_missing(df, ["value"], "ffill", order_by="event_id")) == \
        rows(missing.fill_missing(base, ["value"], "ffill", order_by="event_id"))
    assert rows(profile.column_profile(df)) == rows(profile.column_profile(base))
