import json
import os
import tempfile

import pytest

from spruce.operators import missing
from spruce.plans import recipe
from spruce.sources import io
from spruce.streaming import rowwise


@pytest.fixture()
def log_df(spark):
    return spark.createDataFrame([(1, "x"), (2, None), (2, None), (4, "y"), (5, "z")], "a long, b string")


def test_replay_undo_audit(log_df):
    steps = [recipe.make_step("fill_missing", {"strategy": "constant", "constant": "q"}, ["b"]),
             recipe.make_step("remove_duplicates", {"keep": "first"})]
    out = recipe.replay(log_df, steps)
    assert out.count() == 4 and out.where("b IS NULL").count() == 0
    undone, kept = recipe.undo(log_df, steps)
    assert undone.count() == 5 and len(kept) == 1
    rep = {r.step: r for r in recipe.audit_report(log_df, steps).collect()}
    assert rep[1].missing_cells_before == 2 and rep[1].missing_cells_after == 0
    assert rep[2].rows_before == 5 and rep[2].rows_after == 4
    doc = json.loads(recipe.recipe_to_json(steps))
    assert doc["version"] == "1.0" and [s["operation"] for s in doc["steps"]] == ["fill_missing",
                                                                                  "remove_duplicates"]
    assert recipe.recipe_from_json(recipe.recipe_to_json(steps))[0]["params"]["constant"] == "q"
    with pytest.raises(ValueError):
        recipe.apply_step(log_df, {"operation": "nope", "params": {}})
    assert recipe.replay(log_df, steps, checkpoint_every=1).count() == 4


def test_stream_guard():
    assert rowwise.is_row_wise({"operation": "map_values", "params": {}})
    with pytest.raises(ValueError):
        rowwise.apply_to_stream(None, [{"operation": "fill_missing", "params": {"strategy": "mean"}}])


def test_stream_apply(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(" A ",), ("b",)], "k string").write.parquet(str(src))
    stream = spark.readStream.schema("k string").parquet(str(src))
    out = rowwise.apply_to_stream(stream, [recipe.make_step("standardize_categorical",
                                                            {"operations": ["trim", "lower"]}, ["k"])])
    q = out.writeStream.format("memory").queryName("spruce_stream_t").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.sql("SELECT k FROM spruce_stream_t").collect()) == ["a", "b"]


def test_csv_load(spark, tmp_path):
    p = tmp_path / "data.csv"
    p.write_text('name,age,city\nAlice,30,"New\nYork"\nBob,NA,LA\nCy,25,\n')
    df = io.read_table(spark, str(p))
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "city": "string"}
    rows = sorted(df.collect())
    assert rows[0].city == "New\nYork" and rows[1].age is None
    h = tmp_path / "empty.csv"
    h.write_text("a,b\n")
    assert io.read_table(spark, str(h)).count() == 0


def test_json_shapes(spark, tmp_path):
    rec = tmp_path / "rec.json"
    rec.write_text(json.dumps([{"name": "A", "age": 1, "city": "x"}, {"name": "B", "age": 2, "city": "y"}]))
    assert io.read_table(spark, str(rec)).count() == 2
    cols = tmp_path / "cols.json"
    cols.write_text(json.dumps({"a": [1, 2, 3], "b": ["x", "y", "z"], "c": [1.5, 2.5, 3.5]}))
    df = io.read_table(spark, str(cols))
    assert df.count() == 3 and df.columns == ["a", "b", "c"]
    one = tmp_path / "one.json"
    one.write_text(json.dumps({"a": 1, "b": "x"}))
    assert io.read_table(spark, str(one)).count() == 1
    with pytest.raises(ValueError):
        io.read_table(spark, str(tmp_path / "data.xml"))
    with pytest.raises(ValueError):
        io.read_table(spark, None)


def test_csv_roundtrip_and_blank(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5), ("", 2, None)], "name string, age long, score double")
    out = str(tmp_path / "out")
    io.write_csv(df, out)
    back = io.load_csv(spark, out)
    assert sorted(back.collect(), key=lambda r: r.age)[0].name == "a"
    assert io.blank_to_null(df).where("name IS NULL").count() == 1
    empty = str(tmp_path / "empty")
    io.write_csv(df.limit(0), empty)
    assert os.path.isdir(empty)


def test_fill_partitioned(spark):
    df = spark.createDataFrame([(1, "u", 1.0), (2, "u", None), (3, "v", None), (4, "v", 4.0), (5, "v", None)],
                               "i long, g string, v double")
    out = {r.i: r.v for r in missing.fill_missing(df, ["v"], "ffill", order_by="i", partition_by="g").collect()}
    assert out == {1: 1.0, 2: 1.0, 3: None, 4: 4.0, 5: 4.0}
    tempfile.gettempdir()
