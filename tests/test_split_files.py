"""CSV with quoted line breaks and one large JSON document, read from byte ranges, against whole-file readers."""

import csv
import json
import random

import pytest

from spruce.sources import io, ranges


@pytest.fixture()
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that small files are many tasks."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


CELLS = ["a", "b,c", "line\nbreak", "two\n\nbreaks", 'q"uote', '""', '"', ",", " x ", "é🙂", "1", "2.5", "x" * 50, "\n", '5" pipe', "\r\n", ',"', '",', "y\n" * 400]


def test_csv_with_line_breaks(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    want = []
    for f, end in enumerate(["\n", "\r\n"]):
        rows = [[str(1000 * f + i), *[rng.choice(CELLS if i != 70 else CELLS[-1:]) for _ in range(2)]] for i in range(150)]
        with open(tmp_path / f"f {f}.csv", "w", newline="") as h:
            out = csv.writer(h, lineterminator=end)
            out.writerows([["id", "a", "b c"], *rows])
        want += rows
    parts = ranges.pieces(spark, str(tmp_path), "\n")
    assert parts.rdd.getNumPartitions() > 20 and ranges.records(parts, io._csv_step, "\n").rdd.getNumPartitions() > 20
    got = io.load_csv(spark, str(tmp_path))
    assert dict(got.dtypes) == {"id": "bigint", "a": "string", "b c": "string"}
    assert sorted([str(r[0]), r[1], r[2]] for r in got.collect()) == sorted(want)


def test_stray_quotes_open_nothing(spark, tmp_path, small_ranges):
    rows = [["1", '5" pipe', "x"], ["2", 'a "b" c"', "y\nz"], ["3", "", 'q""']]
    (tmp_path / "s.csv").write_text('i,a,b\n1,5" pipe,x\n2,a "b" c","y\nz"\n3,,"q"""""\n\n')
    got = io.load_csv(spark, str(tmp_path / "s.csv"))
    assert sorted([str(r[0]), r[1] or "", r[2]] for r in got.collect()) == rows


@pytest.mark.parametrize("line,inside,after", [('a,b', False, False), ('a,"b', False, True), ('a,b"', False, False), ('x"', True, False),
                                               ('x""', True, True), ('"",""', False, False), ('"', False, True), ('""', False, False),
                                               ('"""', False, True), ('x","y', True, True), ('', True, True), ('"a""",', False, False)])
def test_quote_machine(line, inside, after):
    assert io._csv_step(line, inside) == (after, 0)


def deep(rng):
    value = rng.choice([1, 2.5, True, None, "x", 'q"uote', "{[", "}]", "back\\slash", "\\", 'end\\"', "é🙂", "a\nb"])
    return {"k": value if isinstance(value, str) else "n", "o": {"l": [rng.randint(0, 9) for _ in range(rng.randint(0, 3))], "s": "}," * rng.randint(0, 3)}, "n": rng.randint(0, 99)}


@pytest.mark.parametrize("indent", [None, 2])
def test_one_document_of_records_is_many_tasks(spark, tmp_path, small_ranges, indent):
    rng = random.Random(3)
    rows = [deep(rng) for _ in range(200)]
    path = tmp_path / "one doc.json"
    path.write_text("﻿ \n" * (indent is None) + json.dumps(rows, indent=indent, ensure_ascii=indent is None) + "\n")
    got = io.load_json(spark, str(path))
    assert ranges.pieces(spark, str(path), "}").rdd.getNumPartitions() > 10
    text = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(text(json.loads(x)) for x in got.toJSON().collect()) == sorted(map(text, rows))


def test_folder_of_mixed_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1, "y": "a"}, {"x": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"x": [3, 4], "y": ["b", "c"]}))
    (tmp_path / "c.json").write_text(" [ ]\n")
    got = io.load_json(spark, str(tmp_path))
    assert sorted((r.x, r.y) for r in got.collect() if r.y) == [(1, "a"), (3, "b"), (4, "c")] and got.count() == 4


def test_no_records_and_no_objects(spark, tmp_path):
    (tmp_path / "e.json").write_text("[]")
    assert io.load_json(spark, str(tmp_path / "e.json")).count() == 0
    for bad in ("[1, 2]", "3", '[{"a": 1}, 2]'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception):
            io.load_json(spark, str(tmp_path / "bad.json")).collect()
