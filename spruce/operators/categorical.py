"""Text and category tools: case, trim, standardise, map values, rare categories, one-hot."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import as_list, c, check_names, require
from ..functions.text import null_tokens_to_null, py_strip, py_title
from .heavy import frequencies


def standardize_case(df: DataFrame, columns: Iterable[str], case: str = "lower") -> DataFrame:
    """Lower / upper / title case; the texts '', 'nan', 'None', 'null' become null."""
    cols = require(df, as_list(columns))
    fn = {"lower": F.lower, "upper": F.upper, "title": py_title}.get(case)
    if fn is None:
        raise ValueError("case must be 'lower', 'upper' or 'title'")
    return df.withColumns({k: null_tokens_to_null(fn(c(k).cast("string"))) for k in cols})


def trim_whitespace(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Strip leading and trailing whitespace (Python's rule); null tokens become null."""
    cols = require(df, as_list(columns))
    return df.withColumns({k: null_tokens_to_null(py_strip(c(k).cast("string"))) for k in cols})


def standardize(df: DataFrame, columns: Iterable[str], operations=("trim", "lower")) -> DataFrame:
    """Trim first (if asked), then the first of lower / upper / title asked for."""
    ops = [o.lower() for o in operations]
    cols = as_list(columns)
    if "trim" in ops:
        df = trim_whitespace(df, cols)
    for case in ("lower", "upper", "title"):
        if case in ops:
            return standardize_case(df, cols, case)
    return df


LITERAL_ENTRIES = 200  # of a mapping that stays a literal; larger ones are joined
BROADCAST_BYTES = 64 << 20  # measured size up to which a lookup table is broadcast


def map_values(df: DataFrame, column: str, mapping: dict | DataFrame, set_unmatched_to_other: bool = False,
               other: str = "Other") -> DataFrame:
    """Replace values by a mapping; optionally unmatched (and null) -> 'Other'.

    ``mapping`` is a dict or a DataFrame of two columns, key and value.  A small dict is a literal map expression; a
    larger one, and a DataFrame, is joined on the key: broadcast if its measured size allows, by an exchange otherwise.
    A key that stands in the table twice is an error (ValueError); null keys match nothing.
    """
    require(df, [column])
    if isinstance(mapping, DataFrame):
        return _map_by_table(df, column, mapping, set_unmatched_to_other, other)
    x = c(column)
    if not mapping:
        return df.withColumn(column, F.lit(other)) if set_unmatched_to_other else df
    keys = list(mapping.keys())
    mixed = len({isinstance(v, str) for v in mapping.values() if v is not None}) > 1
    if len(mapping) > LITERAL_ENTRIES:
        text = mixed or any(isinstance(v, str) for v in mapping.values())
        plain = all(isinstance(k, str) for k in keys)
        rows = [(str(k) if plain else k, str(v) if text and v is not None else v) for k, v in mapping.items() if k is not None]
        if any(isinstance(v, float) for _, v in rows):
            rows = [(k, float(v) if isinstance(v, int) and not isinstance(v, bool) else v) for k, v in rows]
        table = df.sparkSession.createDataFrame(rows, ["key", "value"])
        return _map_by_table(df, column, table, set_unmatched_to_other, other)
    m = F.create_map(*[x for k, v in mapping.items()
                       for x in (F.lit(k), F.lit(str(v) if mixed and v is not None else v))])
    key = x.cast("string") if all(isinstance(k, str) for k in keys) else x
    hit = F.try_element_at(m, key)
    if set_unmatched_to_other:
        return df.withColumn(column, F.coalesce(hit.cast("string"), F.lit(other)))
    found = F.array_contains(F.map_keys(m), key)
    text = any(isinstance(v, str) for v in mapping.values()) or isinstance(df.schema[column].dataType, T.StringType)
    if text:  # one type on both sides
        hit, x = hit.cast("string"), x.cast("string")
    return df.withColumn(column, F.when(found, hit).otherwise(x))


def _map_by_table(df: DataFrame, column: str, table: DataFrame, set_unmatched_to_other: bool, other: str) -> DataFrame:
    if len(table.columns) != 2:
        raise ValueError("a lookup table has two columns, key and value")
    k, v = table.columns
    text_key = isinstance(table.schema[k].dataType, T.StringType)
    t = table.select(c(k).alias("__key"), c(v).alias("__value")).where("__key IS NOT NULL")
    size = t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.col(x).cast("string")), F.lit(0)) for x in t.columns),
                                                                    F.lit(32))), F.lit(0)).alias("bytes")).first()
    twice = t.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the key {twice[0][0]!r} stands in the lookup table twice")
    t = t.withColumn("__hit", F.lit(True))
    x = c(column).cast("string") if text_key else c(column)
    j = df.join(F.broadcast(t) if size["bytes"] <= BROADCAST_BYTES else t, x == F.col("__key"), "left")
    hit, old = F.col("__value"), c(column)
    if set_unmatched_to_other:
        out = F.coalesce(hit.cast("string"), F.lit(other))
    else:
        if isinstance(table.schema[v].dataType, T.StringType) or isinstance(df.schema[column].dataType, T.StringType):
            hit, old = hit.cast("string"), old.cast("string")
        out = F.when(F.col("__hit"), hit).otherwise(old)
    return j.withColumn(column, out).select(*[c(n) for n in df.columns])


def rare_categories(df: DataFrame, column: str, threshold_pct: float = 5.0) -> DataFrame:
    """Each non-null value's share (% of non-null rows) where it is below the threshold."""
    require(df, [column])
    counts = df.where(c(column).isNotNull()).groupBy(c(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    total = df.where(c(column).isNotNull()).agg(F.count(F.lit(1)).alias("_t")).first()["_t"]
    if not total:
        return counts.withColumn("pct", F.lit(None).cast("double")).limit(0)
    pct = F.col("count") / F.lit(float(total)) * 100
    return counts.withColumn("pct", pct).where(F.col("pct") < threshold_pct)


def group_rare_categories(df: DataFrame, column: str, threshold_pct: float = 5.0,
                          replacement: str = "Other") -> DataFrame:
    """Values below the share threshold (strictly) become ``replacement``; null stays null.

    The result is text, whether a value is rare or not.  The rare-value table
    is joined back; Spark chooses the join.
    """
    rare = rare_categories(df, column, threshold_pct).select(F.col("value").alias("__rare"))
    j = df.join(rare, c(column) == F.col("__rare"), "left")
    out = F.when(F.col("__rare").isNotNull(), F.lit(replacement)).otherwise(c(column).cast("string"))
    return j.withColumn(column, out).drop("__rare")


def distinct_within(df: DataFrame, cols: list[str], most: int | None) -> dict[str, list]:
    """The sorted distinct values of columns that will become a part of the schema; ValueError if one has more than ``most``."""
    if not cols:
        return {}
    if most is not None:
        for k, f in frequencies(df, cols).items():
            if f.distinct > most:
                raise ValueError(f"column {k!r} has more than {most} distinct values ({f.distinct}); set a higher limit if that is meant")

    def there(k):
        kind = df.schema[k].dataType  # adding zero makes -0.0 and 0.0 one value
        return F.when(~F.isnan(c(k)), c(k) + F.lit(0).cast(kind)) if isinstance(kind, (T.DoubleType, T.FloatType)) else c(k)

    row = df.agg(*[F.array_sort(F.collect_set(there(k))).alias(f"v{i}") for i, k in enumerate(cols)]).first()
    return {k: list(row[f"v{i}"]) for i, k in enumerate(cols)}


def one_hot_encode(df: DataFrame, columns: Iterable[str], drop_first: bool = False,
                   max_values: int | None = 10_000) -> DataFrame:
    """``{col}_{value}`` 0/1 columns in sorted value order; the source column is removed.

    The output schema depends on the data, so the distinct values are counted first, for all columns in one job.  A column with
    more than ``max_values`` (10,000 unless given; None is no limit) is an error before any value is collected; else one
    job reads the values of all columns.  NaN is missing and gets no column.  Names that
    differ only in case fail, as no later step could tell the columns apart.
    """
    cols = require(df, as_list(columns))
    values = distinct_within(df, cols, max_values)
    new = {}
    for k in cols:
        vals = values[k]
        if drop_first:
            vals = vals[1:]
        for v in vals:
            name = f"{k}_{v}"
            new[name] = F.coalesce((c(k) == F.lit(v)).cast("long"), F.lit(0).cast("long"))
    keep = [x for x in df.columns if x not in cols]
    out = df.select(*[c(x) for x in keep], *[e.alias(n) for n, e in new.items()])
    check_names(out)
    return out
