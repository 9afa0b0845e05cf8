"""Sources and sinks: CSV and JSON as pandas reads them, parquet, CSV output.

Readers take paths (a file, a folder or a glob), so the scan is split over
the cluster; nothing is read on the driver.
"""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import c
from ..functions.text import is_number_text
from . import ranges

# Texts that pandas.read_csv reads as missing by default.
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_INT = r"^\s*[+-]?\d+\s*$"


# Texts that pandas.read_csv reads as booleans.
CSV_TRUE, CSV_FALSE = ["True", "TRUE", "true"], ["False", "FALSE", "false"]


# How fields are quoted.
CSV_FORM = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "PERMISSIVE"}


def _csv_step(line: str, inside: bool) -> tuple[bool, int]:
    """Whether a quoted field is open behind the line.  A quote opens one at the start of a field only, and two in it are one."""
    if '"' not in line:
        return inside, 0
    bits, i = line.split('"'), 0
    while i < len(bits) - 1:
        if not inside:
            inside = bits[i].endswith(",") or (i == 0 and bits[0] == "")
        elif bits[i + 1] == "" and i + 1 < len(bits) - 1:  # two quotes
            i += 1
        else:
            inside = False
        i += 1
    return inside, 0


def csv_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of CSV files whose quoted fields hold line breaks, as text columns; a large file is many tasks.

    Spark's CSV parser reads each record; the first record of a file is its header.  The parsed rows are written once
    to ``spark.checkpoint.dir``, as cutting reads the files three times.
    """
    from ..operators.stats import _materialize
    lines = ranges.pieces(spark, path, "\n")
    found = ranges.records(lines, _csv_step, "\n")
    text = F.regexp_replace("record", r"\r?\n?$", "")
    found = found.where(~F.col("first") & (F.trim(text) != ""))
    parsed = F.from_csv(text, _ddl(schema), {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_FORM.items()})
    return _materialize(found.select(parsed.alias("r")).select("r.*"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in schema.fields)


def load_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Header row, quoted fields, NA texts -> null, types inferred.

    Every column is read as text first; one aggregate then checks per column
    whether all non-null values are integers, numbers or booleans (pandas' rule), and
    the column is cast accordingly.  Integers beyond 64 bits become
    decimal(20, 0), beyond that they stay text.  Dates stay text, as in pandas.
    Files are split over tasks.  Without ``multi_line`` one pass looks for lines with an open quote; if there are any, records are
    cut at their true borders (``csv_records``), in byte ranges too.  With ``multi_line`` given, Spark reads the files
    alone: line by line (False), or a file a task (True).
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.translate("value", '"', ""))
        split = bool(spark.read.text(path).agg(F.bool_or(quotes % 2 == 1)).first()[0])
    else:
        split = False
    plain = spark.read.options(header=True, multiLine=bool(multi_line) or split, inferSchema=False, **CSV_FORM).csv(path)
    raw = csv_records(spark, path, plain.schema) if split else plain
    df = raw.select(*[F.when(c(k).isin(CSV_NA_TOKENS), F.lit(None).cast("string")).otherwise(c(k)).alias(k)
                      for k in raw.columns])
    if not df.columns:
        return df
    probe = df.agg(*[F.bool_and(F.coalesce(c(k).rlike(_INT), F.lit(True))).alias(f"i{i}")
                     for i, k in enumerate(df.columns)],
                   *[F.bool_and(F.coalesce(is_number_text(c(k)), F.lit(True))).alias(f"n{i}")
                     for i, k in enumerate(df.columns)],
                   *[F.bool_and(F.coalesce(c(k).isin(CSV_TRUE + CSV_FALSE), F.lit(True))).alias(f"b{i}")
                     for i, k in enumerate(df.columns)],
                   *[F.bool_and(F.coalesce(F.trim(c(k)).try_cast("long").isNotNull() | c(k).isNull(), F.lit(True)))
                     .alias(f"l{i}") for i, k in enumerate(df.columns)],
                   *[F.max(F.length(F.regexp_replace(c(k), "^\\s*[+-]?0*|\\s*$", ""))).alias(f"w{i}")
                     for i, k in enumerate(df.columns)],
                   *[F.count(c(k)).alias(f"c{i}") for i, k in enumerate(df.columns)]).first()
    out = []
    for i, k in enumerate(df.columns):
        if probe is None:
            out.append(c(k))
        elif probe[f"c{i}"] == 0:
            out.append(c(k).cast("double").alias(k))  # pandas: a column with no values is float
        elif probe[f"b{i}"]:
            out.append(F.when(c(k).isNotNull(), c(k).isin(CSV_TRUE)).alias(k))
        elif probe[f"i{i}"] and probe[f"l{i}"]:
            out.append(F.trim(c(k)).cast("long").alias(k))
        elif probe[f"i{i}"]:
            out.append(F.trim(c(k)).cast("decimal(20,0)").alias(k) if probe[f"w{i}"] <= 20 else c(k))
        elif probe[f"n{i}"]:
            out.append(F.trim(c(k)).try_cast("double").alias(k))
        else:
            out.append(c(k))
    return df.select(*out)


def _json_step(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open behind the piece, which ends before a ``}``, and the change of depth with that ``}``."""
    if "\\" in piece:
        piece = re.sub(r"\\.", "", piece, flags=re.S)
    depth = 0
    for i, bit in enumerate(piece.split('"')):
        if i:
            inside = not inside
        if not inside:
            depth += bit.count("{") + bit.count("[") - bit.count("]") - bit.count("}")
    return inside, depth - (not inside)


def json_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The objects of files that hold one array each; a large file is many tasks.

    Text is cut at ``}`` and put together to the objects of the array; Spark finds the schema from them and parses them.  What stands between
    objects must be commas and white space, else the read fails.
    """
    parts = ranges.pieces(spark, paths, "}")
    found = ranges.records(parts, _json_step, "}", nested=1)
    # the border's } is left off by the cut; behind a file's last object the closing bracket is left over
    body = F.regexp_replace("record", r"^[\s,\[\uFEFF]+", "")
    rows = found.select(body.alias("body")).where(~F.col("body").rlike(r"^\]?[\s}]*$"))
    rows = rows.select(F.concat("body", F.lit("}")).alias("text"))
    schema = spark.read.option("mode", "FAILFAST").json(rows.rdd.map(lambda r: r["text"])).schema
    if not schema.fields:
        return spark.createDataFrame([], schema)
    return rows.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _json_kinds(spark: SparkSession, path) -> dict[str, list[str]]:
    """Files by the first character that is not white space: ``[`` holds records, ``{`` an object."""
    first = F.substring(F.regexp_replace("value", r"^[\s\uFEFF]+", ""), 1, 1)
    parts = ranges.pieces(spark, path, "}").select("file", "block", first.alias("first"))
    # a file begins in the range at byte 0; of that range's pieces the first comes first
    begun = parts.where("block = 0 AND first <> ''").withColumn("at", F.monotonically_increasing_id())
    kinds: dict[str, list[str]] = {}
    for r in begun.groupBy("file").agg(F.min_by("first", "at").alias("first")).collect():  # a row for each file
        kinds.setdefault(r["first"], []).append(unquote(r["file"]))
    return kinds


def load_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A list of records, an object of equal-length lists (columns) or one object (one row).

    The shape is judged for each file; the rows of a folder's files are put together by name.  A document that begins
    with ``[`` holds records, whatever their cells are: one row each, cut from byte ranges, so that one large document is
    many tasks.  Only an object's lists are zipped into rows (``arrays_zip`` + ``inline``); an object is read by one task.
    Anything else fails.
    """
    if lines:  # one record per line (what Spark and most exporters write)
        return spark.read.option("mode", "FAILFAST").json(path)
    kinds = _json_kinds(spark, path)
    if not kinds or set(kinds) - {"[", "{"}:
        raise ValueError("Unsupported JSON structure. Expected a list or dict.")
    parts = [read(spark, kinds[k]) for k, read in (("[", json_records), ("{", _json_objects)) if k in kinds]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _json_objects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one object each: a row each, or the rows of its equal-length lists."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(paths)
    if "_corrupt_record" in raw.columns:
        raise ValueError("Unsupported JSON structure. Expected a list or dict.")
    fields = raw.schema.fields
    arrays = [f.name for f in fields if isinstance(f.dataType, T.ArrayType)]
    if not arrays:
        return raw
    scalars = [f.name for f in fields if f.name not in arrays]
    sizes = [F.coalesce(F.size(c(k)), F.lit(-1)) for k in arrays]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    checked = raw.withColumn("_ok", F.assert_true(same, F.lit("All arrays must be of the same length")))
    zipped = checked.select(*[c(k) for k in scalars], F.arrays_zip(*[c(k) for k in arrays]).alias("_z"), "_ok")
    rows = zipped.select(*[c(k) for k in scalars], F.inline_outer("_z"), "_ok").drop("_ok")
    return rows.select(*[c(f.name) for f in fields])


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str | None, fmt: str | None = None) -> DataFrame:
    """S3: choose the reader by ``fmt`` or the lower-cased file extension."""
    if path is None:
        raise ValueError("No file uploaded.")
    kind = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if kind == "csv":
        return load_csv(spark, path)
    if kind == "json":
        return load_json(spark, path)
    if kind in ("jsonl", "ndjson"):
        return load_json(spark, path, lines=True)
    if kind == "parquet":
        return load_parquet(spark, path)
    raise ValueError(f"Unsupported file format: {os.path.basename(path)}. "
                     "Please upload a CSV, JSON or Parquet file.")


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text cells become null."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({k: F.when(c(k) == "", F.lit(None).cast("string")).otherwise(c(k)) for k in strings})


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    import uuid

    from ..session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/spruce-io/{uuid.uuid4().hex}/{name}"


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header row, UTF-8, one folder of part files; an empty table keeps its header."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", "UTF-8").csv(path))
    return path
