"""Lookup tables of a million entries, hundreds of correlated columns, merged profile states, limits before collecting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spruce import map_values, one_hot_encode
from spruce.operators import categorical, chartdata, merged, profile


def test_a_million_entries(spark, monkeypatch):
    table = spark.range(1_000_000).select(F.concat(F.lit("k"), "id").alias("k"), F.concat(F.lit("v"), F.col("id") % 10).alias("v"))
    df = spark.createDataFrame([("k0",), ("k999999",), ("k1000000",), (None,), ("K0",)], "x string")
    for size in (64 << 20, 10):  # broadcast, and joined by an exchange
        monkeypatch.setattr(categorical, "BROADCAST_BYTES", size)
        assert sorted(map_values(df, "x", table).collect(), key=str) == sorted([("v0",), ("v9",), ("k1000000",), (None,), ("K0",)], key=str)
        assert sorted(r.x for r in map_values(df, "x", table, set_unmatched_to_other=True).collect()) == ["Other", "Other", "Other", "v0", "v9"]


def test_large_dicts_equal_literal_ones(spark, monkeypatch):
    df = spark.createDataFrame([(i % 50 if i % 7 else None, f"s{i % 50}") for i in range(300)], "n long, s string")
    maps = [("n", {i: i * 2 for i in range(30)}), ("n", {i: f"t{i}" for i in range(30)}), ("n", {str(i): i / 2 for i in range(30)}),
            ("s", {f"s{i}": i for i in range(30)}), ("s", {f"s{i}": (f"x{i}" if i % 2 else None) for i in range(30)})]
    for other in (False, True):
        for k, m in maps:
            small = map_values(df, k, m, other)
            monkeypatch.setattr(categorical, "LITERAL_ENTRIES", 5)
            large = map_values(df, k, m, other)
            monkeypatch.undo()
            assert large.dtypes == small.dtypes and sorted(large.collect(), key=str) == sorted(small.collect(), key=str)


def test_ambiguous_tables_fail(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(ValueError, match="twice"):
        map_values(df, "x", spark.createDataFrame([("a", "b"), ("a", "c")], "k string, v string"))
    with pytest.raises(ValueError, match="two columns"):
        map_values(df, "x", df)


def test_three_hundred_columns(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 300)) + rng.normal(size=(400, 300)) + 1e6
    base[rng.random(base.shape) < 0.1] = np.nan
    base[:, 7] = 5.0  # constant
    base[:200, 8], base[200:, 9] = np.nan, np.nan  # no common row
    df = spark.createDataFrame([tuple(map(float, r)) for r in base], ", ".join(f"c{i} double" for i in range(300))).repartition(4)
    got = np.full((300, 300), np.nan)
    for r in chartdata.correlation_matrix(df).collect():
        got[int(r.col_a[1:]), int(r.col_b[1:])] = np.nan if r["corr"] is None else r["corr"]
    assert np.isnan(got[7]).all() and np.isnan(got[8, 9]) and np.allclose(np.diag(np.delete(np.delete(got, 7, 0), 7, 1)), 1)
    few = [f"c{i}" for i in range(12)]
    want = {(r.col_a, r.col_b): r["corr"] for r in chartdata.correlation_matrix(df, few).collect()}
    for (a, b), r in want.items():
        x = got[int(a[1:]), int(b[1:])]
        assert (r is None and np.isnan(x)) or abs(r - x) < 1e-6
    import pandas as pd
    whole = pd.DataFrame(base).corr(min_periods=1).to_numpy()
    ok = ~np.isnan(got)
    assert np.abs(got[ok] - whole[ok]).max() < 1e-6


def test_merged_states_equal_the_state_of_all(spark):
    df = spark.range(20_000).selectExpr("id", "id % 777 AS few", "CASE WHEN id % 9 = 0 THEN NULL ELSE concat('t', id % 5000) END AS t",
                                        "CASE WHEN id % 4 = 0 THEN double('NaN') ELSE id / 7 END AS v")
    parts = [merged.profile_state(df.where(f"id % 3 = {i}")) for i in range(3)]
    old = merged.merge_states(parts[0].unionByName(parts[1]))
    both = {r["column"]: r.asDict() for r in merged.profile_of(old.unionByName(parts[2])).collect()}
    whole = {r["column"]: r.asDict() for r in merged.profile_of(merged.profile_state(df)).collect()}
    exact = {r["column"]: r["unique_count"] for r in profile.column_profile(df).collect()}
    for k, r in whole.items():
        assert {x: v for x, v in both[k].items() if x != "unique_count"} == {x: v for x, v in r.items() if x != "unique_count"}
        for got in (r["unique_count"], both[k]["unique_count"]):
            assert abs(got / exact[k] - 1) < 5 * 1.04 / 64  # five standard errors
    assert both["t"]["null_count"] == 2223 and both["v"]["null_count"] == 5000
    empty = merged.profile_of(merged.profile_state(df.limit(0)))
    assert {r["unique_count"] for r in empty.collect()} == {0}


def test_limits_come_before_collecting(spark):
    df = spark.range(300).selectExpr("cast(id as string) AS a", "id % 3 AS b", "1 AS y")
    with pytest.raises(ValueError, match="more than 100 distinct values"):
        one_hot_encode(df, ["b", "a"], max_values=100)
    with pytest.raises(ValueError, match="more than 10 distinct values"):
        chartdata.bar_grouped_wide(df, "b", "y", "a", max_values=10)
    assert len(one_hot_encode(df, ["a", "b"], max_values=None).columns) == 304
