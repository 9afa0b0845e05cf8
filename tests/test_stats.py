import numpy as np
import pytest

from spruce.operators import stats


@pytest.mark.parametrize("accuracy,select", [(4, 10 ** 9), (4, 1), (30, 1), (10_000, 10 ** 9), (10_000, 0)])
def test_exact_quantiles_whatever_the_sketch(spark, monkeypatch, accuracy, select):
    # rough sketches make wide brackets, no room to select makes them be narrowed; skewed data with a hot value
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    monkeypatch.setattr(stats, "SELECT", select)
    rng = np.random.default_rng(7)
    vals = list(rng.exponential(50, 3000)) + [42.0] * 1500 + [1e6, -3.0]
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(vals)], "v double, g long")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = stats.quantiles(df, "v", probs)
    assert got == pytest.approx(list(np.percentile(vals, [p * 100 for p in probs])), rel=1e-12)
    t = {r.g: [r[f"q{j}"] for j in range(len(probs))]
         for r in stats.quantile_table(df, "v", probs, by="g").collect()}
    for g in range(3):
        sub = [v for i, v in enumerate(vals) if i % 3 == g]
        assert t[g] == pytest.approx(list(np.percentile(sub, [p * 100 for p in probs])), rel=1e-12)


def test_quantiles_empty_and_constant(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert stats.quantiles(df, "v", [0.5]) == [None]
    c = spark.createDataFrame([(3.0,)] * 5, "v double")
    assert stats.quantiles(c, "v", [0.25, 0.5]) == [3.0, 3.0]


def test_quantiles_with_infinity_nan_and_zeros(spark):
    inf = float("inf")
    vals = [inf, -inf, -0.0, 0.0, 1e308, -1e308, 5e-324, 1.5, 2.5, 2.5]
    df = spark.createDataFrame([(v, "a") for v in vals] + [(float("nan"), "a"), (None, "a")], "v double, g string")
    probs = [0.0, 1 / 9, 4 / 9, 6 / 9, 1.0]
    want = [-inf, -1e308, 5e-324, 2.5, inf]
    assert stats.column_quantiles(df, ["v"], probs)["v"] == pytest.approx(want)
    assert list(stats.quantile_table(df, "v", probs, by="g").first())[1:] == pytest.approx(want)


def test_columns_share_the_passes(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=999), rng.integers(0, 5, 999)
    df = spark.createDataFrame([(float(x), int(y), None) for x, y in zip(a, b)], "a double, b long, c double")
    want = {"a": list(np.percentile(a, [25, 50])), "b": list(np.percentile(b, [25, 50])), "c": [None, None]}
    for n in (1, 3, 16):
        got = stats.column_quantiles(df.repartition(n), ["a", "b", "c"], [0.25, 0.5])
        assert got["a"] == pytest.approx(want["a"], rel=1e-14) and got["b"] == want["b"] and got["c"] == want["c"]


def test_mode_smallest_of_most_frequent(spark):
    df = spark.createDataFrame([(10,), (9,), (9,), (10,), (1,)], "x long")
    assert stats.mode_values(df, ["x"]) == {"x": "9"}


@pytest.mark.parametrize("select,passes", [(10 ** 9, 2), (0, 3)])
def test_number_of_passes(spark, monkeypatch, select, passes):
    """Every row is read twice, or three times where brackets are narrowed, for all columns and probabilities together."""
    monkeypatch.setattr(stats, "SELECT", select)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    base = spark.range(4000).selectExpr("cast(id * 37 % 4001 as double) as a", "cast(id % 11 as double) as b", "id % 5 as g")
    df = base.mapInArrow(counted, base.schema)
    got = stats.column_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.99])
    rows = base.toPandas()
    for k in ("a", "b"):
        assert got[k] == pytest.approx(list(np.percentile(rows[k], [0, 25, 50, 99])), rel=1e-13)
    assert seen.value == passes * 4000
    seen.value = 0
    t = {r.g: r.q0 for r in stats.quantile_table(df, "a", [0.5], by="g").collect()}
    assert t == pytest.approx(dict(rows.groupby("g")["a"].median())) and seen.value == passes * 4000


def test_small_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in range(60) for v in rng.integers(0, 9, rng.integers(1, 40))]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [i / 20 for i in range(21)]
    for r in stats.quantile_table(df, "v", probs, by="g").collect():
        assert list(r)[1:] == pytest.approx(list(np.percentile([v for g, v in rows if g == r.g], [p * 100 for p in probs])), abs=1e-12)
