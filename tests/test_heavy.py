"""Most frequent values and distinct counts by fingerprints and sketches: exact whether the sketch's bound closes or not."""

import random
from collections import Counter

import pytest

from spruce.operators import heavy, profile, stats


def brute(values, top):
    n = Counter(values)
    return len(n), sorted(n.items(), key=lambda x: (-x[1], x[0]))[:top]


@pytest.mark.parametrize("tracked,named", [(10_000, 128), (32, 8), (8, 2)])
def test_exact_whatever_the_sketch_holds(spark, monkeypatch, tracked, named):
    monkeypatch.setattr(heavy, "TRACKED", tracked)
    monkeypatch.setattr(heavy, "NAMED", named)
    rng = random.Random(tracked)
    rows = [(rng.choice(["a", "b", "c"] * 30 + [f"x{i}" for i in range(300)]), f"u{i}", None if i % 3 else "z", "same", int(rng.paretovariate(1)))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "hot string, every string, few string, one string, num long").repartition(5)
    got = heavy.frequencies(df, df.columns, 4)
    for i, k in enumerate(df.columns):
        distinct, top = brute([r[i] for r in rows if r[i] is not None], 4)
        assert got[k].distinct == distinct and got[k].top == [(str(v), n) for v, n in top]
    assert got["few"].closed and got["one"].closed
    if tracked < 100:
        assert not got["every"].closed  # all values equally frequent: counted in full
    assert stats.mode_values(df, ["hot", "num", "few"]) == {k: got[k].top[0][0] for k in ("hot", "num", "few")}


def test_a_closed_bound_moves_no_other_values(spark, monkeypatch):
    def full(*a):
        raise AssertionError("the full table was counted")
    monkeypatch.setattr(heavy, "_count_all", full)
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 5 = 0 THEN 'warm' ELSE concat('v', id) END AS x")
    f = heavy.frequencies(df, ["x"], 2)["x"]
    assert f.closed and f.top == [("hot", 10_000), ("warm", 4_000)] and f.distinct == 16_002


def test_nulls_nan_zeros_and_empty(spark):
    df = spark.createDataFrame([(0.0, None), (-0.0, None), (float("nan"), None), (None, None), (2.0, None), (10.0, None), (10.0, None)], "x double, y string")
    got = heavy.frequencies(df, ["x", "y"], 3)
    assert got["x"].distinct == 3 and got["x"].top == [("0.0", 2), ("10.0", 2), ("2.0", 1)] and got["y"] == heavy.Frequencies()
    assert heavy.frequencies(df.limit(0), ["x", "y"], 3) == {"x": heavy.Frequencies(), "y": heavy.Frequencies()}
    assert heavy.frequencies(df, []) == {} and stats.mode_values(df, []) == {}


def test_context_reads_all_columns_in_two_scans(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    base = spark.range(500).selectExpr("id", "concat('a', id % 7) AS a", "concat('b', id % 5) AS b", "concat('c', id % 3) AS c", "id / 2 AS v")
    df = base.mapInArrow(counted, base.schema)
    rows = {r["column"]: r for r in profile.dataset_context(df).collect()}
    assert seen.value == 2 * 500
    assert rows["a"]["top_values"] == "a0, a1, a2, a3, a4" and rows["v"]["max"] == 249.5 and rows["id"]["unique_count"] == 500


def test_first_rows_as_text(spark):
    df = spark.createDataFrame([(3, "c", None), (1, "a", 1.5), (2, None, 2.5)], "i long, s string, v double")
    rows = [(r["row"], r["column"], r["value"]) for r in profile.context_rows(df, 2, "i").orderBy("row", "ordinal").collect()]
    assert rows == [(1, "i", "1"), (1, "s", "a"), (1, "v", "1.5"), (2, "i", "2"), (2, "s", None), (2, "v", "2.5")]
