"""op13 against brute force: pruned blocks, ties, odd rows; the Hilbert keys and the bounds by themselves."""

import numpy as np
import pytest

from spruce.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score long, number int"


def brute(rows, is_anchor, scale=256, least=80, most=100, k=5):
    held = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(scale * x)) for x in v]
            held[i] = min(held.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in held.items():
        if is_anchor(a):
            s = sorted((-dot(q, r), i, other) for i, (other, r) in held.items() if i != a)
            for ps, p, _ in [x for x in s if x[2] == label][:k]:
                fit = [x for x in s if x[2] != label and least * -ps <= 100 * -x[0] <= most * -ps]
                out += [(a, p, n + 1, i, -ps, -ns) for n, (ns, i, _) in enumerate(fit[:k])]
    return sorted(out)


def rows_near_centres(seed, n=400, d=6, centres=5, same=60):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, d))
    rows = [(i, (at[i % centres] + 0.1 * rng.normal(size=d)).round(3).tolist(), int(rng.integers(3))) for i in range(n - same)]
    return rows + [(i, rows[3][1], int(rng.integers(3))) for i in range(n - same, n)]  # one vector many times: ties


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_with_many_small_blocks(spark, seed):
    rows = rows_near_centres(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hardneg.hard_negatives(df, (hardneg.F.col("id") % 9 == 0), block=16, chunk=8, seeds=1, group=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 9 == 0)


def test_odd_rows(spark):
    rows = [(0, [0.1, 0.2], 1, "x", 1, 1), (100, [0.3, 0.1], 1, "x", 1, 1), (1, [0.3, 0.1], 1, None, None, None), (2, [0.3, 0.1], 2, "", 2, 2),
            (2, [0.3, 0.1], 2, "", 2, 2), (3, [0.25, 0.1], 2, "", 2, 2), (3, [0.3, 0.1], 1, "", 2, 2), (None, [0.1, 0.1], 1, "", 1, 1),
            (4, None, 1, "", 1, 1), (5, [0.1, None], 1, "", 1, 1), (6, [0.1, float("nan")], 2, "", 1, 1),
            (7, [float("inf"), 0.1], 2, "", 1, 1), (8, [0.3, 0.1], None, "", 1, 1), (9, [-1.0, -1.0], 2, "", 1, 1), (10, [0.2, 0.2], 3, "", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = hardneg.hard_negatives(df, hardneg.F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 100 == 0) != []
    for none in (df.limit(0), df.where("vec_id = 4")):
        empty = hardneg.hard_negatives(none)
        assert empty.collect() == [] and empty.schema.simpleString() == got.schema.simpleString()
    assert hardneg.hard_negatives(df, hardneg.F.lit(False)).collect() == []
    big = spark.createDataFrame([(1, [1e300], 1), (2, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        hardneg.hard_negatives(big)
    mixed = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1), (3, [1.0, 1.0], 1), (4, [0.9], 2)], "vec_id long, embedding array<double>, label int")
    assert {r.negative_id for r in hardneg.hard_negatives(mixed).collect()} == {4}


def test_hilbert_keys_walk_by_single_steps():
    side = np.arange(16)
    points = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    keys = [k.tobytes() for k in hardneg.hilbert_keys(points)]
    order = sorted(range(len(points)), key=lambda i: keys[i])
    assert len(set(keys)) == len(points)
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(4)
    a, points = rng.integers(-9, 9, (20, 5)), rng.integers(-9, 9, (30, 5))
    low, high = hardneg.bounds(a, points.min(axis=0)[None], points.max(axis=0)[None])
    s = a @ points.T
    assert (low <= s).all() and (high >= s).all()


def test_blocks_are_pruned(spark, tmp_path):
    rows = rows_near_centres(5, n=600, d=4, same=0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q, d, far = hardneg.usable(df, "vec_id", "embedding", "label", 256.0)
    hardneg.write_blocks(q, str(tmp_path / "b"), 16, far)
    zones = spark.read.parquet(str(tmp_path / "b")).toPandas()
    assert zones["n"].sum() == 600 and zones["n"].max() <= 16 and zones["number"].is_unique
    _, up = hardneg.bounds(np.stack(zones["q"].map(lambda v: v[:d])), np.stack(zones["mins"]), np.stack(zones["maxs"]))
    own = np.diag(up)
    assert (up >= own[:, None] * 0.9).mean() < 0.5  # most blocks cannot hold an anchor's near rows


def test_vectors_do_not_go_through_the_driver(spark, tmp_path):
    rows = rows_near_centres(6, n=300, d=4, same=0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q, d, far = hardneg.usable(df, "vec_id", "embedding", "label", 256.0)
    assert q.schema["q"].dataType.simpleString() == "array<smallint>"
    hardneg.write_blocks(q, str(tmp_path / "b"), 16, far)
    blocks = spark.read.parquet(str(tmp_path / "b"))
    anchors = q.select(hardneg.F.lit(0).cast("long").alias("chunk"), "*")
    state = q.selectExpr("id AS anchor_id", "0 AS w", f"{hardneg.LOW}L AS lo", f"{hardneg.HIGH}L AS hi", f"{hardneg.LOW}L AS floor",
                         f"{hardneg.HIGH}L AS floor_id")
    found = hardneg._search(blocks, hardneg._chunks(anchors, state, 1), d, 1, blocks.count(), 1, True, 3, True, None, 8)
    assert found.count() == 900
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()  # the tables are far below any threshold
    assert plan.count("SortMergeJoin") >= 4 and "Broadcast" not in plan


@pytest.mark.parametrize("scale,kind", [(2.0 ** 7, "smallint"), (2.0 ** 20, "int"), (2.0 ** 26, "int")])
def test_whole_numbers_of_every_width(spark, scale, kind):
    rows = rows_near_centres(7, n=120, d=3, same=10)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert hardneg.usable(df, "vec_id", "embedding", "label", scale)[0].schema["q"].dataType.simpleString() == f"array<{kind}>"
    got = hardneg.hard_negatives(df, (hardneg.F.col("id") % 9 == 0), scale=scale, block=16, chunk=8, seeds=1, group=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 9 == 0, scale)
