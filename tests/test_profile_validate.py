import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spruce.operators import chartdata as ch
from spruce.operators import profile as prof
from spruce.operators import validate as val


@pytest.fixture()
def prof_df(spark):
    rows = []
    for i in range(100):
        rows.append((i, f"n{i % 10}", None if 10 <= i <= 15 else float(i % 7),
                     None if 20 <= i <= 25 else ["x", "y", "z"][i % 3],
                     None if 30 <= i <= 32 else float(i % 5), dt.datetime(2024, 1, 1) + dt.timedelta(days=i)))
    rows += rows[:3]
    return spark.createDataFrame(rows, "id long, name string, price double, category string, rating double, "
                                       "date timestamp_ntz")


def test_column_profile(prof_df):
    p = {r.column: r for r in prof.column_profile(prof_df).collect()}
    assert p["price"].null_count == 6 and p["category"].null_count == 6 and p["rating"].null_count == 3
    assert p["id"].unique_count == 100 and p["category"].unique_count == 3
    assert p["price"].null_pct == round(6 / 103 * 100, 2)
    approx = {r.column: r.unique_count for r in prof.column_profile(prof_df, approx=True).collect()}
    assert approx["category"] == 3


def test_duplicates_and_overview(prof_df):
    d = prof.duplicate_stats(prof_df).first()
    assert (d.rows, d.duplicates) == (103, 3)
    o = prof.overview(prof_df).first()
    assert o.columns == 6 and o.missing_cells == 15 and o.duplicates == 3


def test_missing_and_describe(prof_df):
    m = {r.column: r.missing_count for r in prof.missing_table(prof_df).collect()}
    assert m == {"price": 6, "category": 6, "rating": 3}
    desc = {r.column: r for r in prof.numeric_describe(prof_df).collect()}
    vals = [r.price for r in prof_df.collect() if r.price is not None]
    assert desc["price"].q50 == pytest.approx(np.percentile(vals, 50))
    assert desc["price"].std == pytest.approx(np.std(vals, ddof=1))
    c = prof.categorical_describe(prof_df, ["category"]).first()
    assert c["count"] == 97 and c.unique == 3 and c.top == "x"


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "a long, b double")
    assert prof.duplicate_stats(empty).first().duplicate_pct == 0.0
    assert prof.overview(empty).first().missing_pct == 0.0
    nul = spark.createDataFrame([(1, None), (2, None), (3, None)], "a long, b double")
    p = {r.column: r for r in prof.column_profile(nul).collect()}
    assert p["b"].null_pct == 100.0 and p["b"].unique_count == 0


def test_previews(spark):
    df = spark.createDataFrame([(i, i * 2) for i in range(20)], "i long, j long")
    assert [r.i for r in prof.head_preview(df, 3, "i").collect()] == [0, 1, 2]
    assert [r.i for r in prof.tail_preview(df, 3, "i").collect()] == [17, 18, 19]


def test_validation(spark):
    df = spark.createDataFrame([(1, 25.0, "A", 50), (2, -5.0, "B", 60), (3, 150.0, "C", 110),
                                (4, None, None, 70), (5, 30.0, "A", 80), (6, 40.0, "B", 90)],
                               "id long, age double, status string, score long")
    rules = [val.ValidationRule("range", "age", {"min": 0, "max": 120}),
             val.ValidationRule("allowed", "status", {"values": ["A", "B"]}),
             val.ValidationRule("non_null", "age"),
             val.ValidationRule("range", "nope", {"min": 0}),
             val.ValidationRule("range", "score", {"max": 100})]
    v = val.validate_rules(df, rules, key_cols="id")
    got = sorted((r.id, r.rule_type, r.detail) for r in v.collect())
    assert (2, "range", "Below minimum (0)") in got and (3, "range", "Above maximum (120)") in got
    assert (3, "allowed", "Not in allowed values: ['A', 'B']") in got
    assert (4, "non_null", "Null value found") in got and (3, "range", "Above maximum (100)") in got
    assert len(got) == 5
    clean = spark.createDataFrame([(1,), (2,)], "x long")
    e = val.validate_rules(clean, [val.ValidationRule("range", "x", {"min": 0})])
    assert e.count() == 0 and e.columns == ["column", "rule_type", "value", "detail"]
    s = {(r.column, r.rule_type): r.violations for r in val.violation_summary(v).collect()}
    assert s[("age", "range")] == 2


def test_chart_data(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(0, 1, 100)
    rows = [(float(a), float(a * 2 + 1), ["A", "B", "C"][i % 3]) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, y double, category string")
    h = [r["count"] for r in ch.histogram(df, "x", 10).orderBy("bin").collect()]
    assert h == list(np.histogram(x, bins=10)[0])
    hg = ch.histogram_grouped(df, "x", "category", 5)
    assert hg.count() == 15 and hg.agg(F.sum("count")).first()[0] == 100
    c = {(r.col_a, r.col_b): r.corr for r in ch.correlation_matrix(df).collect()}
    assert c[("x", "y")] == pytest.approx(1.0)
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert {(r.col_a, r.col_b): r.corr for r in ch.correlation_matrix(const).collect()}[("a", "b")] is None
    b = ch.bar_aggregate(df, "category", "y", "count", top_n=2).collect()
    assert len(b) == 2
    box = ch.box_stats(df, "x").first()
    assert box.median == pytest.approx(np.median(x))
    wide = ch.bar_grouped_wide(df, "category", "y", "category", "sum")
    assert set(wide.columns) == {"category", "A", "B", "C"}
    assert ch.scatter_bins(df, "x", "y", 4).groupBy().sum("count").first()[0] == ch.scatter_points(df, "x", "y").dropna().count()
