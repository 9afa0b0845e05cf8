"""Duplicates by row fingerprints: exact under collisions, nulls told apart, and only candidates moved."""

import random

import pytest
from pyspark.sql import functions as F

from spruce.operators import dedup, profile

COLS = "a string, b long, v double, t string"


def table(spark, seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "x", "y", ""]), rng.choice([None, 1, 2]), rng.choice([None, 0.0, -0.0, float("nan"), 1.5]), rng.choice("pq"))
            for _ in range(n)]
    return spark.createDataFrame(rows, COLS).repartition(5)


def norm(rows):
    return sorted((tuple("nan" if x != x else (0.0 if x == 0 and isinstance(x, float) else x) for x in r) for r in rows), key=str)


def brute_repeats(rows, key, order):
    groups = {}
    for r in norm(rows):
        groups.setdefault(tuple(r[i] for i in key), []).append(r)
    rank = lambda r: tuple((x is not None, x == "nan", 0 if x == "nan" or x is None else x) for x in [*(r[i] for i in order), *r])
    return sorted((r for g in groups.values() for r in sorted(g, key=rank)[1:]), key=str)


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("subset,order", [(["a", "b"], ["v"]), (["a", "v"], ["t", "b"]), (["a", "b", "v", "t"], None), (["t", "a"], None)])
def test_exact_also_when_all_fingerprints_collide(spark, monkeypatch, collide, subset, order):
    if collide:
        monkeypatch.setattr(dedup, "row_key", lambda cols: (F.lit(1).cast("long"), F.pmod(F.xxhash64(*cols), F.lit(3)).cast("long")))
    df = table(spark, len(subset)).cache()
    rows = df.collect()
    at = [df.columns.index(k) for k in subset]
    by = [df.columns.index(k) for k in order or []]
    repeats = brute_repeats(rows, at, by)
    assert norm(dedup.find_duplicates(df, subset, order).collect()) == repeats
    keys = {tuple(r[i] for i in at) for r in norm(rows)}
    kept = norm(dedup.remove_duplicates(df, subset, "first", order).collect())
    assert len(kept) == len(keys) and sorted(kept + repeats, key=str) == norm(rows)
    groups = dedup.duplicate_groups(df, subset).collect()
    assert len(groups) == len(repeats) + len({tuple(r[i] for i in at) for r in repeats})
    second = norm(dedup.duplicate_occurrences(df, subset, order).collect())
    assert len(second) == len({tuple(r[i] for i in at) for r in repeats}) and set(second) <= set(repeats)


def test_duplicate_counts(spark, monkeypatch):
    df = table(spark, 9).cache()
    n = df.count()
    repeats = len(brute_repeats(df.collect(), range(4), []))
    for _ in range(2):
        assert tuple(profile.duplicate_stats(df).first()) == (n, repeats, round(100 * repeats / n, 2))
        o = profile.overview(df).first()
        assert (o["rows"], o["duplicates"]) == (n, repeats)
        assert o["missing_cells"] == sum(x is None or x != x for r in df.collect() for x in r)
        monkeypatch.setattr(dedup, "row_key", lambda cols: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    none = df.limit(0)
    assert tuple(profile.duplicate_stats(none).first()) == (0, 0, 0.0)
    assert dedup.find_duplicates(none, ["a"], "b").collect() == [] == dedup.remove_duplicates(none).collect()


def test_nulls_at_other_places_are_other_rows(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, None)], "x string, y string")
    assert len({tuple(r) for r in df.select(*dedup.row_key(["x", "y"])).collect()}) == 3
    assert [tuple(r) for r in dedup.find_duplicates(df).collect()] == [("a", None)]


def test_only_candidates_are_read_whole(spark):
    """Of 2,000 long rows 20 stand twice: nothing else reaches an exchange, and no sort aggregate holds rows."""
    df = spark.range(2000).select(F.least("id", F.lit(1979)).alias("k"), F.repeat(F.lit("text "), 200).alias("t"), F.lit("x").alias("u"))
    assert dedup.candidates(df).count() == 21
    for found in (dedup.find_duplicates(df), dedup.remove_duplicates(df), profile.duplicate_stats(df), profile.overview(df)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
    assert len(dedup.remove_duplicates(df, ["k", "t", "u"]).collect()) == 1980
