"""Column profiles that are kept and merged (F1): one small row for each column of each file, day or batch.

A state row holds counts, range and a HyperLogLog sketch of the column's values; the states of any parts of a table merge
to the state of the whole without reading old data.  Counts, nulls and ranges of a merged state are exact; the distinct count is
an estimate whose standard error is 1.04 / sqrt(2 ** lg) (1.6 % at the default), as if the whole table had been sketched at once.
States are plain rows (binary sketch), so they are stored as Parquet like any table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import as_double, is_numeric
from .heavy import _key
from .profile import _missing, _pct

STATE = ["ordinal", "column", "dtype", "rows", "nulls", "min", "max", "distinct_sketch"]


def profile_state(df: DataFrame, lg: int = 12) -> DataFrame:
    """The state of every column, from one scan."""
    cols = list(df.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, k in enumerate(cols):
        aggs += [F.count_if(_missing(df, k)).alias(f"_m{i}"), F.hll_sketch_agg(_key(df, k, "a"), lg).alias(f"_s{i}")]
        if is_numeric(df.schema[k].dataType):
            aggs += [F.min(as_double(k)).alias(f"_lo{i}"), F.max(as_double(k)).alias(f"_hi{i}")]
    none = F.lit(None).cast("double")
    one = df.agg(*aggs)
    items = [F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("column"), F.lit(df.schema[k].dataType.simpleString()).alias("dtype"),
                      F.col("_rows").alias("rows"), F.col(f"_m{i}").alias("nulls"),
                      *[(F.col(f"_{n}{i}") if is_numeric(df.schema[k].dataType) else none).alias(a) for n, a in (("lo", "min"), ("hi", "max"))],
                      F.col(f"_s{i}").alias("distinct_sketch")) for i, k in enumerate(cols)]
    return one.select(F.explode(F.array(*items)).alias("_c")).select("_c.*")


def merge_states(states: DataFrame) -> DataFrame:
    """One state row for each column from any number of them; sketches of different width merge to the narrower."""
    return states.groupBy("column").agg(
        F.min("ordinal").alias("ordinal"), F.max("dtype").alias("dtype"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.hll_union_agg("distinct_sketch", F.lit(True)).alias("distinct_sketch")).select(*STATE)


def profile_of(states: DataFrame) -> DataFrame:
    """F1's table of merged states: column, dtype, non_null_count, null_count, null_pct, unique_count (an estimate), min, max, ordinal."""
    return merge_states(states).select(
        "column", "dtype", (F.col("rows") - F.col("nulls")).alias("non_null_count"), F.col("nulls").alias("null_count"),
        _pct(F.col("nulls"), F.col("rows"), 2).alias("null_pct"), F.hll_sketch_estimate("distinct_sketch").alias("unique_count"), "min", "max", "ordinal")
