"""Records that do not end at every line break, read from byte ranges of large files.

A file is read as pieces between single separator bytes, which Spark's text reader cuts into byte ranges (one task each, wherever
the range begins).  Whether a range begins inside a quoted text cannot be seen in the range, so it is worked out in three steps:

1. each range is scanned once for both cases, which gives what it does to the state: for either state at its start,
   the state at its end and the change of the nesting depth;
2. a range's effect on "inside or not" is keeping it, turning it, or setting it; the state at each start follows from a running
   sum over the ranges of a file (a table with one row for each range), and so does the depth;
3. each range is cut into records from its known start.  What stands before the first true border and behind the last
   one are fragments, two a range at most; they are put together by the order of the ranges.

Scanning is Python in tasks, a piece at a time, and holds one record; nothing passes through the driver.  The table of starts is
broadcast to keep the lines in their order: one row for a range, so 100 TB in ranges of 128 MB are under a million rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (piece, inside) -> (inside at its end, change of depth)
Step = Callable[[str, bool], tuple[bool, int]]


def pieces(spark: SparkSession, path, separator: str) -> DataFrame:
    """(value, file, block): the pieces between separators, with the file and the first byte of the range that holds them."""
    return spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def starts(parts: DataFrame, step: Step) -> DataFrame:
    """(file, block, inside, depth): the state at the start of each range."""

    def effects(batches):
        at, state = None, None
        for b in batches:
            for value, file, block in zip(b["value"], b["file"], b["block"]):
                if at != (file, block):
                    if at:
                        yield pd.DataFrame([(*at, *state)], columns=["file", "block", "e0", "d0", "e1", "d1"])
                    at, state = (file, block), (False, 0, True, 0)
                (e0, c0), (e1, c1) = step(value, state[0]), step(value, state[2])
                state = (e0, state[1] + c0, e1, state[3] + c1)
        if at:
            yield pd.DataFrame([(*at, *state)], columns=["file", "block", "e0", "d0", "e1", "d1"])

    ends = parts.mapInPandas(effects, "file string, block long, e0 boolean, d0 long, e1 boolean, d1 long")
    from ..operators.stats import _materialize
    ends = _materialize(ends)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("e0") != F.col("e1"), F.col("e0").cast("long")).otherwise(0)  # else the range sets the state, whatever it was
    ends = ends.withColumn("turned", F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fixed = F.when(F.col("e0") == F.col("e1"), F.struct(F.col("e0").cast("long").alias("to"), F.col("turned").alias("turned")))
    ends = ends.withColumns({"fixed": F.last(fixed, ignorenulls=True).over(before), "so_far": F.coalesce(F.lag("turned").over(order), F.lit(0))})
    inside = (F.coalesce(F.col("fixed.to"), F.lit(0)) + F.col("so_far") - F.coalesce(F.col("fixed.turned"), F.lit(0))) % 2 == 1
    ends = ends.withColumn("inside", inside)
    depth = F.coalesce(F.sum(F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))).over(before), F.lit(0))
    return ends.select("file", "block", "inside", depth.alias("depth"))


def records(parts: DataFrame, step: Step, separator: str, nested: int = 0) -> DataFrame:
    """(record, file, first): texts from border to border, without the separator at the end; first is True for a file's first.

    A border is the end of a piece at which the text is not inside and the depth is ``nested``.
    """
    known = F.broadcast(starts(parts, step).withColumnsRenamed({"file": "f", "block": "b"}))
    placed = parts.join(known, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")), "left").select(
        "value", "file", "block", F.coalesce("inside", F.raise_error(F.lit("a range without a state")).cast("boolean")).alias("inside"), "depth")

    def cut(batches):
        at, held, inside, depth, kind, first = None, [], False, 0, "", False
        columns = ["record", "file", "block", "kind", "first"]
        for b in batches:
            out = []
            for value, file, block, start, deep in zip(b["value"], b["file"], b["block"], b["inside"], b["depth"]):
                if at != (file, block):
                    if held:
                        out.append((separator.join(held) + separator, *at, kind + "tail", first))
                    at, held, inside, depth = (file, block), [], bool(start), int(deep)
                    kind, first = "head" if inside or (block > 0 and depth != nested) else "", block == 0
                held.append(value)
                inside, change = step(value, inside)
                depth += change
                if not inside and depth == nested:
                    whole = separator.join(held)
                    out.append((whole, *at, kind or "whole", first))
                    held, kind, first = [], "", False
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(separator.join(held) + separator, *at, kind + "tail", first)], columns=columns)

    found = placed.mapInPandas(cut, "record string, file string, block long, kind string, first boolean")
    whole = found.where("kind = 'whole'").select("record", "file", "first")
    # a tail opens a record; heads, and ranges without a border (headtail), go on with the last one opened
    loose = found.where("kind <> 'whole'")
    place = Window.partitionBy("file").orderBy("block", "kind")  # head before tail
    loose = loose.withColumn("chain", F.sum((F.col("kind") == "tail").cast("int")).over(place))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda x: x["record"]), "")
    joined = loose.groupBy("file", "chain").agg(text.alias("record"), F.max("first").alias("first"))
    return whole.unionByName(joined.select("record", "file", "first"))
