"""Registered queries over the test tables, each with its SQL oracle.

The test tables hold no nulls, so dirt is derived with one shared set of
expressions (the same text runs in Spark SQL and DuckDB): null values, case
and padding variants, prices as text, dates as text in three formats.  No
row is dropped by the dirt: every query runs over whole tables.

Computed doubles are rounded to 6 places on both sides before comparing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as _ops  # noqa: F401
from ..operators import (categorical as cat, chartdata as ch, columns as colops, convert as conv, dedup,
                         missing as miss, numeric as num, profile as prof, validate as val)
from ..sources import io as sio
from . import recipe

# ---------------------------------------------------------------- derived tables

DIRTY_EVENTS = [
    "event_id", "ts", "user_id",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value",
    "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN upper(event_type) "
    "WHEN event_id % 5 = 0 THEN '  ' || event_type || ' ' ELSE event_type END AS kind",
]
DIRTY_PART = [
    "p_partkey", "p_brand",
    "CASE WHEN p_partkey % 13 = 0 THEN 'abc' "
    "ELSE '$' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END AS price",
    "CASE WHEN p_partkey % 17 = 0 THEN 'n/a' "
    "ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END AS price_text",
]
_SPARK_DATE_TEXT = ("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
                    "WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') "
                    "ELSE date_format(o_orderdate, 'MM-dd-yyyy') END AS order_date")
_DUCK_DATE_TEXT = ("CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') "
                   "WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') "
                   "ELSE strftime(o_orderdate, '%m-%d-%Y') END AS order_date")

CTE = {
    "de": "de AS (SELECT " + ", ".join(DIRTY_EVENTS) + " FROM events)",
    "dp": "dp AS (SELECT " + ", ".join(DIRTY_PART) + " FROM part)",
    "do": "do_ AS (SELECT o_orderkey, " + _DUCK_DATE_TEXT + " FROM orders)",
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dirty_events(spark, d):
    return _t(spark, d, "events").selectExpr(*DIRTY_EVENTS)


def dirty_part(spark, d):
    return _t(spark, d, "part").selectExpr(*DIRTY_PART)


def dirty_orders(spark, d):
    return _t(spark, d, "orders").selectExpr("o_orderkey", _SPARK_DATE_TEXT)


def round_half_away(x, dp: int = 6):
    """round(x, dp) computed as DuckDB computes it: std::round(x * 10^dp) / 10^dp.

    Spark's ``round`` rounds the decimal text half-up; on exact decimal ties
    the two engines can differ in the last place.  The same IEEE operations
    in the same order give the same double on both sides.
    """
    m = float(10 ** dp)
    a = F.abs(x) * F.lit(m)
    r = F.floor(a).cast("double")
    r = F.when(a - r >= 0.5, r + 1.0).otherwise(r)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.when(x < 0, -r).otherwise(r) / F.lit(m))


def rnd(df: DataFrame, dp: int = 6) -> DataFrame:
    """Round every double column (the oracle rounds the same columns)."""
    return df.select(*[round_half_away(F.col(f"`{f.name}`"), dp).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def with_(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names) + " "


def r6(x: str, alias: str | None = None) -> str:
    return f"round({x}, 6) AS {alias or x}"


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_ORDER = ", ".join(LI_COLS)

# ---------------------------------------------------------------- flagship

FLAGSHIP_SQL = with_("de") + """,
med AS (SELECT quantile_cont(value, 0.5) AS m FROM de),
f AS (SELECT event_id, coalesce(value, (SELECT m FROM med)) AS value,
             CASE WHEN lower(trim(kind)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE lower(trim(kind)) END AS kind
      FROM de),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f),
c AS (SELECT CASE WHEN value IS NULL THEN NULL
                  ELSE least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS value, kind
      FROM f, q)
SELECT kind, round(avg(value), 6) AS value FROM c WHERE kind IS NOT NULL
GROUP BY kind ORDER BY avg(value) DESC, kind LIMIT 3
"""


@query("flagship_clean_events", FLAGSHIP_SQL)
def flagship(spark, d):
    """Median fill -> IQR cap -> standardise -> mean by kind, top 3."""
    df = dirty_events(spark, d)
    df = miss.fill_missing(df, ["value"], "median")
    df = cat.standardize(df, ["kind"], ["trim", "lower"])
    df = num.cap_outliers_iqr(df, "value")
    return rnd(ch.bar_aggregate(df, "kind", "value", "mean", top_n=3))


# ---------------------------------------------------------------- P: filters, columns, formulas

@query("filter_in", "SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linestatus IN ('O')")
def q_filter_in(spark, d):
    return colops.filter_dataframe(_t(spark, d, "lineitem"),
                                   {"l_returnflag": ["A", "N"], "l_linestatus": {"O"}, "no_such": ["x"]})


@query("filter_range", "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 "
                       "AND l_discount BETWEEN 0.02 AND 0.05")
def q_filter_range(spark, d):
    return colops.filter_dataframe(_t(spark, d, "lineitem"),
                                   {"l_quantity": (10, 20), "l_discount": (0.02, 0.05), "l_tax": (1, 2, 3)})


@query("filter_combined", "SELECT * FROM lineitem WHERE l_returnflag IN ('R') AND l_quantity BETWEEN 5 AND 45 "
                          "AND l_extendedprice BETWEEN 1000 AND 50000")
def q_filter_combined(spark, d):
    return colops.filter_dataframe(_t(spark, d, "lineitem"), {
        "l_returnflag": ["R"], "l_quantity": (5, 45), "l_extendedprice": (1000, 50000)})


@query("rename_cols", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total_price, "
                      "o_orderdate AS order_date, o_orderpriority FROM orders")
def q_rename(spark, d):
    return colops.rename_columns(_t(spark, d, "orders"), {"o_totalprice": "total_price",
                                                            "o_orderdate": "order_date", "absent": "x"})


@query("drop_cols", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                    "l_discount, l_returnflag, l_linestatus FROM lineitem")
def q_drop(spark, d):
    return colops.drop_columns(_t(spark, d, "lineitem"), ["l_tax", "l_shipdate", "l_comment"])


@query("formula_arith", "SELECT l_orderkey, l_linenumber, l_partkey, "
                        "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, "
                        "round(l_extendedprice / nullif(l_quantity, 0), 6) AS unit_price, "
                        "(l_quantity > 25 AND l_discount >= 0.05) AS big_discounted, "
                        "round(l_quantity - l_discount * floor(l_quantity / l_discount), 6) AS q_mod "
                        "FROM lineitem")
def q_formula_arith(spark, d):
    df = _t(spark, d, "lineitem")
    df = colops.create_formula_column(df, "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    df = colops.create_formula_column(df, "unit_price", "l_extendedprice / l_quantity")
    df = colops.create_formula_column(df, "big_discounted", "l_quantity > 25 and l_discount >= 0.05")
    df = colops.create_formula_column(df, "q_mod", "l_quantity % l_discount")
    return rnd(df.select("l_orderkey", "l_linenumber", "l_partkey", "charge", "unit_price", "big_discounted",
                         "q_mod"))


@query("formula_log", "SELECT l_orderkey, l_linenumber, l_partkey, "
                      "round(CASE WHEN l_extendedprice > 0 THEN ln(l_extendedprice) END, 6) AS log_price "
                      "FROM lineitem")
def q_formula_log(spark, d):
    df = colops.create_formula_column(_t(spark, d, "lineitem"), "log_price", "log(l_extendedprice)")
    return rnd(df.select("l_orderkey", "l_linenumber", "l_partkey", "log_price"))


@query("formula_demean", "SELECT l_orderkey, l_linenumber, l_partkey, "
                         "round(l_quantity - (SELECT avg(l_quantity) FROM lineitem), 6) AS qty_centered "
                         "FROM lineitem")
def q_formula_demean(spark, d):
    df = colops.create_formula_column(_t(spark, d, "lineitem"), "qty_centered", "l_quantity - mean(l_quantity)")
    return rnd(df.select("l_orderkey", "l_linenumber", "l_partkey", "qty_centered"))


_LI_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
             ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
             ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
             ("l_shipdate", "timestamp_ntz")]


@query("type_sample", "WITH f AS (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       "l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 1) "
       + " UNION ALL ".join(f"SELECT {i} AS ordinal, '{k}' AS column, '{t}' AS dtype, CAST({k} AS VARCHAR) AS sample "
                            f"FROM f" for i, (k, t) in enumerate(_LI_TYPES)))
def q_type_sample(spark, d):
    return prof.sample_types(_t(spark, d, "lineitem"), order_by=["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- T: types

_NUM_GUARD = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def _duck_num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_NUM_GUARD}) THEN TRY_CAST(trim({x}) AS DOUBLE) END"


@query("dirty_numeric", with_("dp") + "SELECT p_partkey, "
       + _duck_num(r"regexp_replace(price, '[£$€¥,\s]', '', 'g')") + " AS price FROM dp")
def q_dirty_numeric(spark, d):
    return conv.clean_dirty_numeric(dirty_part(spark, d), "price").select("p_partkey", "price")


@query("to_numeric", with_("dp") + "SELECT p_partkey, " + _duck_num("price_text") + " AS price_text FROM dp")
def q_to_numeric(spark, d):
    return conv.convert_to_numeric(dirty_part(spark, d), "price_text").select("p_partkey", "price_text")


@query("to_datetime_fmt", with_("do") + "SELECT o_orderkey, "
       "CAST(try_strptime(order_date, '%d/%m/%Y') AS TIMESTAMP) AS order_date FROM do_")
def q_to_datetime_fmt(spark, d):
    return conv.convert_to_datetime(dirty_orders(spark, d), "order_date", "%d/%m/%Y")


@query("to_datetime_auto", with_("do") + """, first AS (SELECT order_date FROM do_ ORDER BY o_orderkey LIMIT 1)
SELECT o_orderkey, CAST(CASE
  WHEN (SELECT order_date FROM first) SIMILAR TO '[0-9]{4}-[0-9]{2}-[0-9]{2}' THEN try_strptime(order_date, '%Y-%m-%d')
  WHEN (SELECT order_date FROM first) SIMILAR TO '[0-9]{2}/[0-9]{2}/[0-9]{4}' THEN
    CASE WHEN CAST(substr((SELECT order_date FROM first), 1, 2) AS INT) <= 12
         THEN try_strptime(order_date, '%m/%d/%Y') ELSE try_strptime(order_date, '%d/%m/%Y') END
  ELSE try_strptime(order_date, '%m-%d-%Y') END AS TIMESTAMP) AS order_date FROM do_""")
def q_to_datetime_auto(spark, d):
    return conv.convert_to_datetime(dirty_orders(spark, d), "order_date", order_by="o_orderkey")


@query("to_datetime_mixed", with_("do") + "SELECT o_orderkey, CAST(coalesce("
       "try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%m/%d/%Y'), "
       "try_strptime(order_date, '%d/%m/%Y'), try_strptime(order_date, '%m-%d-%Y'), "
       "try_strptime(order_date, '%d-%m-%Y')) AS TIMESTAMP) AS order_date FROM do_")
def q_to_datetime_mixed(spark, d):
    return conv.convert_to_datetime_mixed(dirty_orders(spark, d), "order_date")


@query("to_categorical", "SELECT p_partkey, p_brand FROM part")
def q_to_categorical(spark, d):
    return conv.convert_to_categorical(_t(spark, d, "part"), "p_brand").select("p_partkey", "p_brand")


# ---------------------------------------------------------------- C: text and categories

def _tok(x: str) -> str:
    return f"CASE WHEN {x} IN ('', 'nan', 'None', 'null') THEN NULL ELSE {x} END"


_DUCK_TITLE = ("array_to_string(list_transform(regexp_extract_all(kind, '([A-Za-z]+|[^A-Za-z]+)'), "
               "lambda x: upper(x[1]) || lower(x[2:])), '')")


@query("case_lower", with_("de") + f"SELECT event_id, {_tok('lower(kind)')} AS kind FROM de")
def q_case_lower(spark, d):
    return cat.standardize_case(dirty_events(spark, d), ["kind"], "lower").select("event_id", "kind")


@query("case_upper", with_("de") + f"SELECT event_id, {_tok('upper(kind)')} AS kind FROM de")
def q_case_upper(spark, d):
    return cat.standardize_case(dirty_events(spark, d), ["kind"], "upper").select("event_id", "kind")


@query("case_title", with_("de") + f"SELECT event_id, {_tok(_DUCK_TITLE)} AS kind FROM de")
def q_case_title(spark, d):
    return cat.standardize_case(dirty_events(spark, d), ["kind"], "title").select("event_id", "kind")


@query("trim_ws", with_("de") + f"SELECT event_id, {_tok('trim(kind)')} AS kind FROM de")
def q_trim(spark, d):
    return cat.trim_whitespace(dirty_events(spark, d), ["kind"]).select("event_id", "kind")


@query("standardize", with_("de") + f"SELECT event_id, {_tok('lower(' + _tok('trim(kind)') + ')')} AS kind FROM de")
def q_standardize(spark, d):
    return cat.standardize(dirty_events(spark, d), ["kind"], ["trim", "lower", "upper"]).select("event_id", "kind")


_BRAND_MAP = {"Brand#11": "B11", "Brand#12": "B12", "Brand#21": "B21"}


@query("map_values", "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'B11' WHEN 'Brand#12' THEN 'B12' "
                     "WHEN 'Brand#21' THEN 'B21' ELSE p_brand END AS p_brand FROM part")
def q_map_values(spark, d):
    return cat.map_values(_t(spark, d, "part"), "p_brand", _BRAND_MAP).select("p_partkey", "p_brand")


@query("map_values_other", "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'B11' WHEN 'Brand#12' THEN 'B12' "
                           "WHEN 'Brand#21' THEN 'B21' ELSE 'Other' END AS p_brand FROM part")
def q_map_values_other(spark, d):
    return cat.map_values(_t(spark, d, "part"), "p_brand", _BRAND_MAP, set_unmatched_to_other=True) \
        .select("p_partkey", "p_brand")


_RARE_SQL = """, f AS (SELECT kind AS value, count(*) AS count FROM de WHERE kind IS NOT NULL GROUP BY kind),
t AS (SELECT sum(count) AS total FROM f)"""


@query("rare_table", with_("de") + _RARE_SQL + """
SELECT value, count, round(count * 100.0 / total, 6) AS pct FROM f, t WHERE count * 100.0 / total < 5""")
def q_rare_table(spark, d):
    return rnd(cat.rare_categories(dirty_events(spark, d), "kind", 5))


@query("group_rare", with_("de") + _RARE_SQL + """
SELECT event_id, CASE WHEN kind IN (SELECT value FROM f, t WHERE count * 100.0 / total < 5) THEN 'Other'
                      ELSE kind END AS kind FROM de""")
def q_group_rare(spark, d):
    return cat.group_rare_categories(dirty_events(spark, d), "kind", 5).select("event_id", "kind")


_OH = ("CAST(l_returnflag = 'A' AS BIGINT) AS l_returnflag_A, CAST(l_returnflag = 'N' AS BIGINT) AS l_returnflag_N, "
       "CAST(l_returnflag = 'R' AS BIGINT) AS l_returnflag_R, CAST(l_linestatus = 'F' AS BIGINT) AS l_linestatus_F, "
       "CAST(l_linestatus = 'O' AS BIGINT) AS l_linestatus_O")


@query("one_hot", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
                  "l_tax, l_shipdate, " + _OH + " FROM lineitem")
def q_one_hot(spark, d):
    return cat.one_hot_encode(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("one_hot_drop_first", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                             "l_discount, l_tax, l_shipdate, "
                             "CAST(l_returnflag = 'N' AS BIGINT) AS l_returnflag_N, "
                             "CAST(l_returnflag = 'R' AS BIGINT) AS l_returnflag_R, "
                             "CAST(l_linestatus = 'O' AS BIGINT) AS l_linestatus_O FROM lineitem")
def q_one_hot_drop_first(spark, d):
    return cat.one_hot_encode(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], drop_first=True)


# ---------------------------------------------------------------- M: missing values

@query("fill_mean", with_("de") + "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM de)), 6) AS value, "
       "kind FROM de")
def q_fill_mean(spark, d):
    return rnd(miss.fill_missing(dirty_events(spark, d), ["value"], "mean").select("event_id", "value", "kind"))


@query("fill_median", with_("de") + "SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) "
       "FROM de)), 6) AS value, kind FROM de")
def q_fill_median(spark, d):
    return rnd(miss.fill_missing(dirty_events(spark, d), ["value"], "median").select("event_id", "value", "kind"))


@query("fill_mode", with_("de") + """, m AS (SELECT kind FROM de WHERE kind IS NOT NULL GROUP BY kind
                                ORDER BY count(*) DESC, kind LIMIT 1)
SELECT event_id, coalesce(kind, (SELECT kind FROM m)) AS kind FROM de""")
def q_fill_mode(spark, d):
    return miss.fill_missing(dirty_events(spark, d), ["kind"], "mode").select("event_id", "kind")


@query("fill_const", with_("de") + "SELECT event_id, coalesce(value, 0.0) AS value, coalesce(kind, 'unknown') AS kind "
       "FROM de")
def q_fill_const(spark, d):
    df = miss.fill_missing(dirty_events(spark, d), ["value"], "constant", constant=0)
    df = miss.fill_missing(df, ["kind"], "constant", constant="unknown")
    return df.select("event_id", "value", "kind")


@query("ffill", with_("de") + "SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id "
       "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value, last_value(kind IGNORE NULLS) OVER "
       "(ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind FROM de")
def q_ffill(spark, d):
    return miss.fill_missing(dirty_events(spark, d), ["value", "kind"], "ffill", order_by="event_id") \
        .select("event_id", "value", "kind")


@query("bfill", with_("de") + "SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY event_id "
       "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM de")
def q_bfill(spark, d):
    return miss.fill_missing(dirty_events(spark, d), ["value"], "bfill", order_by="event_id") \
        .select("event_id", "value")


@query("ffill_by_user", with_("de") + "SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER "
       "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM de")
def q_ffill_by_user(spark, d):
    return miss.fill_missing(dirty_events(spark, d), ["value"], "ffill", order_by=["ts", "event_id"],
                             partition_by="user_id").select("event_id", "user_id", "value")


@query("drop_null_rows", with_("de") + "SELECT * FROM de WHERE value IS NOT NULL AND kind IS NOT NULL")
def q_drop_null_rows(spark, d):
    return miss.drop_rows_with_nulls(dirty_events(spark, d), ["value", "kind"])


@query("drop_sparse_cols", with_("de") + "SELECT event_id, ts, user_id, kind FROM de")
def q_drop_sparse_cols(spark, d):
    return miss.drop_sparse_columns(dirty_events(spark, d), 10)


# ---------------------------------------------------------------- D: duplicates

_EV_RN = ("row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id, ts, value, props) AS rn")


@query("dups_find", f"SELECT event_id, ts, user_id, event_type, value, props FROM "
                    f"(SELECT *, {_EV_RN} FROM events) WHERE rn > 1")
def q_dups_find(spark, d):
    return dedup.find_duplicates(_t(spark, d, "events"), ["user_id", "event_type"], order_by="event_id")


@query("dups_all", "SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS group_size FROM events "
                   "QUALIFY count(*) OVER (PARTITION BY user_id, event_type) > 1")
def q_dups_all(spark, d):
    return dedup.duplicate_groups(_t(spark, d, "events"), ["user_id", "event_type"])


@query("dups_occurrence", f"SELECT event_id, ts, user_id, event_type, value, props FROM "
                          f"(SELECT *, {_EV_RN} FROM events) WHERE rn = 2")
def q_dups_occurrence(spark, d):
    return dedup.duplicate_occurrences(_t(spark, d, "events"), ["user_id", "event_type"], order_by="event_id")


@query("dedup_first", f"SELECT event_id, ts, user_id, event_type, value, props FROM "
                      f"(SELECT *, {_EV_RN} FROM events) WHERE rn = 1")
def q_dedup_first(spark, d):
    return dedup.remove_duplicates(_t(spark, d, "events"), ["user_id", "event_type"], "first", order_by="event_id")


@query("dedup_last", "SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER "
                     "(PARTITION BY user_id, event_type ORDER BY event_id DESC, ts DESC, value DESC, props DESC) AS rn "
                     "FROM events) WHERE rn = 1")
def q_dedup_last(spark, d):
    return dedup.remove_duplicates(_t(spark, d, "events"), ["user_id", "event_type"], "last", order_by="event_id")


@query("dedup_full_row", "SELECT DISTINCT user_id, event_type FROM events")
def q_dedup_full_row(spark, d):
    return dedup.remove_duplicates(_t(spark, d, "events").select("user_id", "event_type"))


@query("dedup_documents", "SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER "
                          "(PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def q_dedup_documents(spark, d):
    return dedup.remove_duplicates(_t(spark, d, "documents"), ["text"], "first", order_by="doc_id") \
        .select("doc_id", "lang", "source", "n_chars")


# ---------------------------------------------------------------- N: numeric

_IQR = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM de)"
_Z = "(SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM de)"


@query("iqr_stats", with_("de") + f""", q AS {_IQR},
b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr, round(lo, 4) AS lower, round(hi, 4) AS upper,
       count(*) FILTER (WHERE value < lo OR value > hi) AS count,
       round(count(*) FILTER (WHERE value < lo OR value > hi) * 100.0 / count(*), 2) AS pct
FROM de, b GROUP BY q1, q3, iqr, lo, hi""")
def q_iqr_stats(spark, d):
    return num.detect_outliers_iqr(dirty_events(spark, d), "value")


@query("z_stats", with_("de") + f""", z AS {_Z}
SELECT round(mu, 4) AS mean, round(sd, 4) AS std, 3.0 AS threshold,
       count(*) FILTER (WHERE abs((value - mu) / sd) > 3) AS count,
       round(count(*) FILTER (WHERE abs((value - mu) / sd) > 3) * 100.0 / count(*), 2) AS pct
FROM de, z GROUP BY mu, sd""")
def q_z_stats(spark, d):
    return num.detect_outliers_zscore(dirty_events(spark, d), "value", 3.0)


@query("outlier_flag", with_("de") + f""", q AS {_IQR}
SELECT event_id, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS is_outlier
FROM de, q""")
def q_outlier_flag(spark, d):
    return num.flag_outliers(dirty_events(spark, d), "value", "iqr").select("event_id", "is_outlier")


@query("cap_iqr", with_("de") + f""", q AS {_IQR}
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL
  ELSE least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END, 6) AS value FROM de, q""")
def q_cap_iqr(spark, d):
    return rnd(num.cap_outliers_iqr(dirty_events(spark, d), "value").select("event_id", "value"))


@query("cap_z", with_("de") + f""", z AS {_Z}
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL
  ELSE least(greatest(value, mu - 3 * sd), mu + 3 * sd) END, 6) AS value FROM de, z""")
def q_cap_z(spark, d):
    return rnd(num.cap_outliers_zscore(dirty_events(spark, d), "value", 3.0).select("event_id", "value"))


@query("drop_outliers", with_("de") + f""", q AS {_IQR}
SELECT event_id, ts, user_id, value, kind FROM de, q
WHERE NOT coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false)""")
def q_drop_outliers(spark, d):
    return num.remove_outlier_rows(dirty_events(spark, d), "value", "iqr")


@query("scale_minmax", with_("de") + """, m AS (SELECT min(value) AS mn, max(value) AS mx FROM de)
SELECT event_id, round((value - mn) / (mx - mn), 6) AS value FROM de, m""")
def q_scale_minmax(spark, d):
    return rnd(num.min_max_scale(dirty_events(spark, d), ["value"]).select("event_id", "value"))


@query("scale_z", with_("de") + f""", z AS {_Z}
SELECT event_id, round((value - mu) / sd, 6) AS value, round((user_id - um) / us, 6) AS user_id FROM de, z,
  (SELECT avg(user_id) AS um, stddev_samp(user_id) AS us FROM de) u""")
def q_scale_z(spark, d):
    return rnd(num.z_score_scale(dirty_events(spark, d), ["value", "user_id"]).select("event_id", "value", "user_id"))


@query("bin_width", with_("de") + """, m AS (SELECT min(value) AS mn, max(value) AS mx FROM de),
e AS (SELECT list_transform(range(1, 5), lambda k: k * ((mx - mn) / 5) + mn) AS inner_edges FROM m)
SELECT event_id, CASE WHEN value IS NOT NULL THEN
  1 + len(list_filter(inner_edges, lambda x: x < value)) END AS value_binned FROM de, e""")
def q_bin_width(spark, d):
    return num.bin_column(dirty_events(spark, d), "value", 5, "equal_width").select("event_id", "value_binned")


@query("bin_quantile", with_("de") + """, e AS (SELECT list_sort(list_distinct([
    quantile_cont(value, 0.0), quantile_cont(value, 0.25), quantile_cont(value, 0.5),
    quantile_cont(value, 0.75), quantile_cont(value, 1.0)])) AS edges FROM de)
SELECT event_id, CASE WHEN value IS NOT NULL THEN
  1 + len(list_filter(edges[2:len(edges) - 1], lambda x: x < value)) END AS value_binned FROM de, e""")
def q_bin_quantile(spark, d):
    return num.bin_column(dirty_events(spark, d), "value", 4, "quantile").select("event_id", "value_binned")


# ---------------------------------------------------------------- F, L: profile and previews

_DE_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("value", "double"),
            ("kind", "string")]


def _per_column(body: Callable[[int, str, str], str]) -> str:
    return " UNION ALL ".join(body(i, k, t) for i, (k, t) in enumerate(_DE_COLS))


@query("col_profile", with_("de") + _per_column(
    lambda i, k, t: f"SELECT '{k}' AS column, '{t}' AS dtype, count({k}) AS non_null_count, "
                    f"count(*) - count({k}) AS null_count, round((count(*) - count({k})) * 100.0 / count(*), 2) "
                    f"AS null_pct, count(DISTINCT {k}) AS unique_count, {i} AS ordinal FROM de"))
def q_col_profile(spark, d):
    return prof.column_profile(dirty_events(spark, d))


_NUM = [k for k, t in _DE_COLS if t in ("bigint", "double")]


@query("num_describe", with_("de") + " UNION ALL ".join(
    f"SELECT '{k}' AS column, count({k}) AS count, round(avg({k}), 6) AS mean, round(stddev_samp({k}), 6) AS std, "
    f"round(min({k}), 6) AS min, round(quantile_cont({k}, 0.25), 6) AS q25, round(quantile_cont({k}, 0.5), 6) AS q50, "
    f"round(quantile_cont({k}, 0.75), 6) AS q75, round(max({k}), 6) AS max FROM de" for k in _NUM))
def q_num_describe(spark, d):
    return rnd(prof.numeric_describe(dirty_events(spark, d)))


@query("cat_describe", with_("de") + """, f AS (SELECT kind, count(*) AS n FROM de WHERE kind IS NOT NULL GROUP BY kind)
SELECT 'kind' AS column, (SELECT count(kind) FROM de) AS count, (SELECT count(*) FROM f) AS unique,
       (SELECT kind FROM f ORDER BY n DESC, kind LIMIT 1) AS top, (SELECT max(n) FROM f) AS freq""")
def q_cat_describe(spark, d):
    return prof.categorical_describe(dirty_events(spark, d))


@query("missing_table", with_("de") + """SELECT * FROM (
SELECT 'value' AS column, count(*) - count(value) AS missing_count,
       round((count(*) - count(value)) * 100.0 / count(*), 2) AS missing_pct, 3 AS ordinal FROM de
UNION ALL SELECT 'kind', count(*) - count(kind), round((count(*) - count(kind)) * 100.0 / count(*), 2), 4 FROM de)
WHERE missing_count > 0""")
def q_missing_table(spark, d):
    return prof.missing_table(dirty_events(spark, d))


@query("missing_bands", with_("de") + """SELECT *, CASE WHEN missing_pct < 5 THEN 'low' WHEN missing_pct < 20
THEN 'medium' ELSE 'high' END AS band FROM (
SELECT 'value' AS column, count(*) - count(value) AS missing_count,
       round((count(*) - count(value)) * 100.0 / count(*), 2) AS missing_pct, 3 AS ordinal FROM de
UNION ALL SELECT 'kind', count(*) - count(kind), round((count(*) - count(kind)) * 100.0 / count(*), 2), 4 FROM de)
WHERE missing_count > 0""")
def q_missing_bands(spark, d):
    return prof.missing_bands(dirty_events(spark, d))


@query("dup_stats", """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type
FROM events)) AS duplicates, round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)))
* 100.0 / count(*), 2) AS duplicate_pct FROM events""")
def q_dup_stats(spark, d):
    return prof.duplicate_stats(_t(spark, d, "events").select("user_id", "event_type"))


@query("overview", with_("de") + """, s AS (SELECT count(*) AS rows,
  sum((event_id IS NULL)::BIGINT + (ts IS NULL)::BIGINT + (user_id IS NULL)::BIGINT + (value IS NULL)::BIGINT
      + (kind IS NULL)::BIGINT) AS missing_cells FROM de)
SELECT rows, 5 AS columns, missing_cells, round(missing_cells * 100.0 / (rows * 5), 1) AS missing_pct,
  rows - (SELECT count(*) FROM (SELECT DISTINCT * FROM de)) AS duplicates FROM s""")
def q_overview(spark, d):
    return prof.overview(dirty_events(spark, d))


@query("dataset_context", with_("de") + """, f AS (SELECT kind, count(*) AS n FROM de WHERE kind IS NOT NULL
GROUP BY kind), t AS (SELECT string_agg(kind, ', ' ORDER BY n DESC, kind) AS top_values FROM
(SELECT * FROM f ORDER BY n DESC, kind LIMIT 5))
""" + _per_column(
    lambda i, k, t: f"SELECT '{k}' AS column, '{t}' AS dtype, count(*) - count({k}) AS null_count, "
                    f"round((count(*) - count({k})) * 100.0 / count(*), 1) AS null_pct, "
                    f"count(DISTINCT {k}) AS unique_count, "
                    + ("(SELECT top_values FROM t)" if t == "string" else "CAST(NULL AS VARCHAR)") + " AS top_values, "
                    + (f"round(CAST(min({k}) AS DOUBLE), 6)" if t in ("bigint", "double") else "CAST(NULL AS DOUBLE)")
                    + " AS min, "
                    + (f"round(CAST(max({k}) AS DOUBLE), 6)" if t in ("bigint", "double") else "CAST(NULL AS DOUBLE)")
                    + f" AS max, {i} AS ordinal FROM de"))
def q_dataset_context(spark, d):
    return rnd(prof.dataset_context(dirty_events(spark, d)))


@query("distinct_values", with_("de") + "SELECT DISTINCT kind FROM de WHERE kind IS NOT NULL ORDER BY kind LIMIT 50")
def q_distinct_values(spark, d):
    return prof.distinct_values(dirty_events(spark, d), "kind", 50)


@query("before_after_nulls", with_("de") + """SELECT 'before' AS stage, count(*) AS rows,
  sum((value IS NULL)::BIGINT + (kind IS NULL)::BIGINT) AS missing_cells FROM de
UNION ALL SELECT 'after', count(*), sum((kind IS NULL)::BIGINT) FROM de""")
def q_before_after_nulls(spark, d):
    before = dirty_events(spark, d)
    return prof.before_after_nulls(before, miss.fill_missing(before, ["value"], "mean"))


@query("before_after_describe", with_("de") + f""", z AS {_Z}, s AS (SELECT (value - mu) / sd AS value FROM de, z)
SELECT 'before' AS stage, 'value' AS column, count(value) AS count, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
  round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75,
  round(max(value), 6) AS max FROM de
UNION ALL SELECT 'after', 'value', count(value), round(avg(value), 6), round(stddev_samp(value), 6),
  round(min(value), 6), round(quantile_cont(value, 0.25), 6), round(quantile_cont(value, 0.5), 6),
  round(quantile_cont(value, 0.75), 6), round(max(value), 6) FROM s""")
def q_before_after_describe(spark, d):
    before = dirty_events(spark, d)
    return rnd(prof.before_after_describe(before, num.z_score_scale(before, ["value"]), ["value"]))


@query("head_preview", f"SELECT * FROM lineitem ORDER BY {LI_ORDER.replace('l_partkey, l_suppkey, l_linenumber', 'l_linenumber, l_partkey, l_suppkey')} LIMIT 10")
def q_head(spark, d):
    return prof.head_preview(_t(spark, d, "lineitem"), 10, ["l_orderkey", "l_linenumber"])


@query("tail_preview", "SELECT * FROM lineitem ORDER BY "
       + ", ".join(k + " DESC" for k in ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
                   + LI_COLS[4:]) + " LIMIT 10")
def q_tail(spark, d):
    return prof.tail_preview(_t(spark, d, "lineitem"), 10, ["l_orderkey", "l_linenumber"])


@query("top_values", with_("de") + "SELECT kind AS value, count(*) AS count FROM de WHERE kind IS NOT NULL "
       "GROUP BY kind ORDER BY count DESC, kind LIMIT 5")
def q_top_values(spark, d):
    return prof.top_values(dirty_events(spark, d), "kind", 5)


# ---------------------------------------------------------------- H: chart data

_HIST = """, m AS (SELECT {g}min(value) AS mn0, max(value) AS mx0 FROM ev {gb}),
r AS (SELECT {g}CASE WHEN mn0 = mx0 THEN mn0 - 0.5 ELSE mn0 END AS mn,
                CASE WHEN mn0 = mx0 THEN mx0 + 0.5 ELSE mx0 END AS mx FROM m),
p AS (SELECT {gv}value, mn, mx, (mx - mn) / 30 AS step,
             least(CAST(floor((value - mn) * (30 / (mx - mn))) AS INT), 29) AS i0 FROM ev {j}),
p1 AS (SELECT *, i0 - CASE WHEN value < (CASE WHEN i0 >= 30 THEN mx ELSE i0 * step + mn END) THEN 1 ELSE 0 END
          AS i1 FROM p),
p2 AS (SELECT {g}i1 + CASE WHEN value >= (CASE WHEN i1 + 1 >= 30 THEN mx ELSE (i1 + 1) * step + mn END)
          AND i1 <> 29 THEN 1 ELSE 0 END AS bin FROM p1),
c AS (SELECT {g}bin, count(*) AS count FROM p2 GROUP BY {g}bin),
dom AS (SELECT {g}CAST(b AS INT) AS bin, mn, mx, (mx - mn) / 30 AS step FROM r, range(30) AS t(b))
SELECT {gd}dom.bin, round(dom.bin * step + mn, 6) AS bin_start,
       round(CASE WHEN dom.bin = 29 THEN mx ELSE (dom.bin + 1) * step + mn END, 6) AS bin_end,
       coalesce(c.count, 0) AS count
FROM dom LEFT JOIN c ON dom.bin = c.bin {jc}"""


@query("hist", "WITH ev AS (SELECT value FROM events WHERE value IS NOT NULL)" + _HIST.format(
    g="", gb="", gv="", j=", r", gd="", jc=""))
def q_hist(spark, d):
    return rnd(ch.histogram(_t(spark, d, "events"), "value", 30))


@query("hist_grouped", "WITH ev AS (SELECT event_type AS grp, value FROM events WHERE value IS NOT NULL)" + _HIST.format(
    g="grp, ", gb="GROUP BY grp", gv="ev.grp, ", j="JOIN r USING (grp)", gd="dom.grp AS \"group\", ",
    jc="AND dom.grp = c.grp"))
def q_hist_grouped(spark, d):
    return rnd(ch.histogram_grouped(_t(spark, d, "events"), "value", "event_type", 30))


_BOX = """, q AS (SELECT {g}quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                     quantile_cont(value, 0.75) AS q3 FROM ev {gb}),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT {gs}round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(value) FILTER (WHERE value BETWEEN lo AND hi), 6) AS whisker_low,
  round(max(value) FILTER (WHERE value BETWEEN lo AND hi), 6) AS whisker_high,
  count(*) FILTER (WHERE NOT (value BETWEEN lo AND hi)) AS outliers, count(*) AS count
FROM ev {j} GROUP BY {gs}q1, median, q3"""


@query("box_stats", "WITH ev AS (SELECT event_type, value FROM events WHERE value IS NOT NULL)" + _BOX.format(
    g="event_type, ", gb="GROUP BY event_type", gs="event_type, ", j="JOIN b USING (event_type)"))
def q_box_stats(spark, d):
    return rnd(ch.box_stats(_t(spark, d, "events"), "value", "event_type"))


@query("box_stats_all", with_("de") + ", ev AS (SELECT value FROM de WHERE value IS NOT NULL)" + _BOX.format(
    g="", gb="", gs="", j=", b"))
def q_box_stats_all(spark, d):
    return rnd(ch.box_stats(dirty_events(spark, d), "value"))


@query("box_outliers", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, value FROM events JOIN q USING (event_type)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def q_box_outliers(spark, d):
    return ch.box_outliers(_t(spark, d, "events"), "value", "event_type")


@query("scatter_points", "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def q_scatter(spark, d):
    return ch.scatter_points(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query("line_series", with_("de") + "SELECT ts, value FROM de ORDER BY ts NULLS LAST")
def q_line(spark, d):
    return ch.line_series(dirty_events(spark, d), "ts", "value")


def _bar_sql(agg: str) -> str:
    return (f"SELECT l_suppkey, round({agg}, 6) AS value FROM lineitem GROUP BY l_suppkey "
            f"ORDER BY {agg} DESC NULLS LAST, l_suppkey LIMIT 10")


@query("bar_mean", _bar_sql("avg(l_extendedprice)"))
def q_bar_mean(spark, d):
    return rnd(ch.bar_aggregate(_t(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", "mean", 10))


@query("bar_sum", _bar_sql("coalesce(sum(l_extendedprice), 0)"))
def q_bar_sum(spark, d):
    return rnd(ch.bar_aggregate(_t(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", "sum", 10))


@query("bar_count", "SELECT l_suppkey, count(l_extendedprice) AS value FROM lineitem GROUP BY l_suppkey "
                    "ORDER BY value DESC, l_suppkey LIMIT 10")
def q_bar_count(spark, d):
    return ch.bar_aggregate(_t(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", "count", 10)


@query("bar_median", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS value FROM lineitem "
                     "GROUP BY l_returnflag ORDER BY quantile_cont(l_extendedprice, 0.5) DESC, l_returnflag LIMIT 5")
def q_bar_median(spark, d):
    return rnd(ch.bar_aggregate(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "median", 5))


_GL = """WITH g AS (SELECT l_suppkey, l_returnflag, sum(l_extendedprice) AS value FROM lineitem
GROUP BY l_suppkey, l_returnflag),
top AS (SELECT l_suppkey FROM g GROUP BY l_suppkey ORDER BY sum(value) DESC, l_suppkey LIMIT 5)"""


@query("bar_grouped_long", _GL + "SELECT l_suppkey, l_returnflag, round(value, 6) AS value FROM g "
                                 "WHERE l_suppkey IN (SELECT l_suppkey FROM top)")
def q_bar_grouped_long(spark, d):
    return rnd(ch.bar_grouped_long(_t(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", "l_returnflag",
                                   "sum", 5))


@query("bar_grouped_wide", _GL + """SELECT l_suppkey,
  round(max(value) FILTER (WHERE l_returnflag = 'A'), 6) AS A, round(max(value) FILTER (WHERE l_returnflag = 'N'), 6) AS N,
  round(max(value) FILTER (WHERE l_returnflag = 'R'), 6) AS R
FROM g WHERE l_suppkey IN (SELECT l_suppkey FROM top) GROUP BY l_suppkey""")
def q_bar_grouped_wide(spark, d):
    return rnd(ch.bar_grouped_wide(_t(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", "l_returnflag",
                                   "sum", 5))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) "
    f"AS corr FROM lineitem" for a in _CORR_COLS for b in _CORR_COLS))
def q_corr(spark, d):
    return rnd(ch.correlation_matrix(_t(spark, d, "lineitem"), _CORR_COLS))


@query("filter_domains", with_("de") + """SELECT DISTINCT 'kind' AS column, 'values' AS kind, kind AS value,
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max FROM de WHERE kind IS NOT NULL
UNION ALL SELECT 'event_id', 'range', NULL, min(event_id), max(event_id) FROM de
UNION ALL SELECT 'user_id', 'range', NULL, min(user_id), max(user_id) FROM de
UNION ALL SELECT 'value', 'range', NULL, min(value), max(value) FROM de""")
def q_filter_domains(spark, d):
    return ch.filter_domains(dirty_events(spark, d))


# ---------------------------------------------------------------- V: validation

_RULES = [val.ValidationRule("range", "value", {"min": 1, "max": 300}),
          val.ValidationRule("allowed", "kind", {"values": ["click", "view", "purchase", "signup", "error"]}),
          val.ValidationRule("non_null", "value"),
          val.ValidationRule("range", "no_such_column", {"min": 0})]

_V_RANGE = ("SELECT event_id, 'value' AS column, 'range' AS rule_type, CAST(value AS VARCHAR) AS value, "
            "'Below minimum (1)' AS detail FROM de WHERE value < 1 UNION ALL "
            "SELECT event_id, 'value', 'range', CAST(value AS VARCHAR), 'Above maximum (300)' FROM de WHERE value > 300")
_V_ALLOWED = ("SELECT event_id, 'kind' AS column, 'allowed' AS rule_type, kind AS value, "
              "'Not in allowed values: [''click'', ''view'', ''purchase'', ''signup'', ''error'']' AS detail "
              "FROM de WHERE kind IS NOT NULL AND kind NOT IN ('click', 'view', 'purchase', 'signup', 'error')")
_V_NULL = ("SELECT event_id, 'value' AS column, 'non_null' AS rule_type, 'NaN' AS value, 'Null value found' AS detail "
           "FROM de WHERE value IS NULL")


@query("rule_range", with_("de") + _V_RANGE)
def q_rule_range(spark, d):
    return val.validate_rules(dirty_events(spark, d), _RULES[:1], key_cols="event_id")


@query("rule_allowed", with_("de") + _V_ALLOWED)
def q_rule_allowed(spark, d):
    return val.validate_rules(dirty_events(spark, d), _RULES[1:2], key_cols="event_id")


@query("rule_not_null", with_("de") + _V_NULL)
def q_rule_not_null(spark, d):
    return val.validate_rules(dirty_events(spark, d), _RULES[2:3], key_cols="event_id")


@query("rule_set", with_("de") + _V_RANGE + " UNION ALL " + _V_ALLOWED + " UNION ALL " + _V_NULL)
def q_rule_set(spark, d):
    return val.validate_rules(dirty_events(spark, d), _RULES, key_cols="event_id")


@query("violation_summary", with_("de") + "SELECT \"column\", rule_type, count(*) AS violations FROM ("
       + _V_RANGE + " UNION ALL " + _V_ALLOWED + " UNION ALL " + _V_NULL + ") GROUP BY \"column\", rule_type")
def q_violation_summary(spark, d):
    return val.violation_summary(val.validate_rules(dirty_events(spark, d), _RULES, key_cols="event_id"))


# ---------------------------------------------------------------- R: recipes

RECIPE = [
    recipe.make_step("standardize_categorical", {"operations": ["trim", "lower"]}, ["kind"]),
    recipe.make_step("fill_missing", {"strategy": "median"}, ["value"]),
    recipe.make_step("outlier_treatment", {"method": "IQR", "action": "Cap"}, ["value"]),
    recipe.make_step("remove_duplicates", {"subset": ["user_id", "kind"], "keep": "first", "order_by": "event_id"}),
]

_R_STEPS = """, s1 AS (SELECT event_id, ts, user_id, value,
  CASE WHEN lower(trim(kind)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE lower(trim(kind)) END AS kind FROM de),
s2 AS (SELECT event_id, ts, user_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM s1)) AS value, kind FROM s1),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s2),
s3 AS (SELECT event_id, ts, user_id, CASE WHEN value IS NULL THEN NULL
  ELSE least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS value, kind FROM s2, q),
s4 AS (SELECT event_id, ts, user_id, value, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind
  ORDER BY event_id, ts, value) AS rn FROM s3) WHERE rn = 1)"""


@query("recipe_replay", with_("de") + _R_STEPS + " SELECT event_id, ts, user_id, round(value, 6) AS value, kind FROM s4")
def q_recipe_replay(spark, d):
    return rnd(recipe.replay(dirty_events(spark, d), RECIPE))


@query("recipe_undo", with_("de") + _R_STEPS + " SELECT event_id, ts, user_id, round(value, 6) AS value, kind FROM s3")
def q_recipe_undo(spark, d):
    out, _ = recipe.undo(dirty_events(spark, d), RECIPE)
    return rnd(out)


def _audit_row(i: int, op: str, prev: str, cur: str) -> str:
    def st(t):
        return (f"(SELECT count(*) FROM {t})", f"(SELECT sum((event_id IS NULL)::BIGINT + (ts IS NULL)::BIGINT + "
                f"(user_id IS NULL)::BIGINT + (value IS NULL)::BIGINT + (kind IS NULL)::BIGINT) FROM {t})")
    (rb, mb), (ra, ma) = st(prev), st(cur)
    names = "event_id,ts,user_id,value,kind"
    return (f"SELECT {i} AS step, '{op}' AS operation, {rb} AS rows_before, {ra} AS rows_after, 5 AS columns_before, "
            f"5 AS columns_after, {mb} AS missing_cells_before, {ma} AS missing_cells_after, "
            f"'{names}' AS column_names_before, '{names}' AS column_names_after")


@query("audit_report", with_("de") + _R_STEPS + " " + " UNION ALL ".join(
    _audit_row(i + 1, s["operation"], p, q) for i, (s, p, q) in
    enumerate(zip(RECIPE, ["de", "s1", "s2", "s3"], ["s1", "s2", "s3", "s4"]))))
def q_audit(spark, d):
    return recipe.audit_report(dirty_events(spark, d), RECIPE)


# ---------------------------------------------------------------- S: sources and sinks

@query("csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, "
                        "p_retailprice FROM part")
def q_csv_roundtrip(spark, d):
    """Write ``part`` as CSV (S4) into the shared scratch folder, read it back as pandas would."""
    path = sio.write_csv(_t(spark, d, "part"), sio.scratch_path(spark, "part_csv"))
    return sio.read_table(spark, path, "csv")


@query("json_lines_roundtrip", "SELECT p_brand, p_name, p_partkey, p_retailprice, CAST(p_size AS BIGINT) AS p_size, "
                               "p_type FROM part")
def q_json_roundtrip(spark, d):
    path = sio.write_json_lines(_t(spark, d, "part"), sio.scratch_path(spark, "part_json"))
    return sio.read_table(spark, path, "jsonl")


_BLANKED = "CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END AS n_name"


@query("blank_to_null", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS n_name, "
                        "n_regionkey FROM nation")
def q_blank_to_null(spark, d):
    return sio.blank_to_null(_t(spark, d, "nation").selectExpr("n_nationkey", _BLANKED, "n_regionkey"))


@query("violations_csv", with_("de") + _V_RANGE + " UNION ALL " + _V_ALLOWED + " UNION ALL "
       + _V_NULL.replace("'NaN' AS value", "CAST(NULL AS VARCHAR) AS value"))
def q_violations_csv(spark, d):
    """The violation rows written as CSV and read back (the text NaN reads back as missing)."""
    v = val.validate_rules(dirty_events(spark, d), _RULES, key_cols="event_id")
    path = sio.write_csv(v, sio.scratch_path(spark, "violations_csv"))
    back = sio.read_table(spark, path, "csv")
    return back.select("event_id", "column", "rule_type", F.col("value").cast("string").alias("value"), "detail")


# ---------------------------------------------------------------- values and shapes the plain tables do not hold

# events with infinities, NaN, -0.0, a group without values and whole-row copies
_E2 = ["event_type", "CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 10 = 0 THEN CAST('{inf}' AS DOUBLE) "
       "WHEN event_id % 10 = 1 THEN CAST('-{inf}' AS DOUBLE) WHEN event_id % 10 = 2 THEN CAST('NaN' AS DOUBLE) "
       "WHEN event_id % 10 = 3 THEN -0.0 WHEN event_id % 10 = 4 THEN 0.0 ELSE value END AS v"]
_E2_SQL = "WITH e2 AS (SELECT " + ", ".join(_E2).format(inf="Infinity") + " FROM events)"


def dirty_events2(spark, d):
    return _t(spark, d, "events").selectExpr(*[x.format(inf="Infinity") for x in _E2])


@query("quantiles_inf", _E2_SQL + """, f AS (SELECT event_type, v FROM e2 WHERE NOT isnan(v))
SELECT event_type, quantile_disc(v, 0.0) AS q0, round(quantile_cont(v, 0.5), 6) AS q1, quantile_disc(v, 1.0) AS q2
FROM f GROUP BY event_type""")
def q_quantiles_inf(spark, d):
    from ..operators import stats
    t = stats.quantile_table(dirty_events2(spark, d), "v", [0.0, 0.5, 1.0], by="event_type")
    return t.withColumn("q1", round_half_away(F.col("q1")))


@query("median_groups_without_values", _E2_SQL + """
SELECT event_type, round(quantile_cont(v, 0.5) FILTER (NOT isnan(v)), 6) AS value FROM e2 GROUP BY event_type""")
def q_median_no_values(spark, d):
    return rnd(ch.bar_aggregate(dirty_events2(spark, d), "event_type", "v", "median"))


@query("count_without_nan", _E2_SQL + """
SELECT event_type, count(v) FILTER (NOT isnan(v)) AS value FROM e2 GROUP BY event_type""")
def q_count_nan(spark, d):
    return ch.bar_aggregate(dirty_events2(spark, d), "event_type", "v", "count")


@query("distinct_zeros", _E2_SQL + """
SELECT count(DISTINCT CASE WHEN v = 0 THEN 0.0 ELSE v END) FILTER (NOT isnan(v)) AS unique_count FROM e2""")
def q_distinct_zeros(spark, d):
    return prof.column_profile(dirty_events2(spark, d).select("v")).select("unique_count")


@query("dups_find_full_row", """SELECT user_id, event_type FROM (SELECT user_id, event_type,
row_number() OVER (PARTITION BY user_id, event_type) AS rn FROM events) WHERE rn > 1""")
def q_dups_full_row(spark, d):
    return dedup.find_duplicates(_t(spark, d, "events").select("user_id", "event_type"))


@query("num_describe_wide", " UNION ALL ".join(
    f"SELECT '{k}' AS \"column\", count({k}) AS count, round(quantile_cont({k}, 0.25), 6) AS q25, "
    f"round(quantile_cont({k}, 0.5), 6) AS q50, round(quantile_cont({k}, 0.75), 6) AS q75 FROM lineitem"
    for k in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_partkey")))
def q_describe_wide(spark, d):
    t = prof.numeric_describe(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_partkey"])
    return rnd(t.select("column", "count", "q25", "q50", "q75"))


@query("scatter_bins", """SELECT least((l_quantity::INTEGER - 1) // 7, 6)::INTEGER AS x_bin,
least((l_orderkey % 50) // 7, 6)::INTEGER AS y_bin, count(*) AS count FROM lineitem GROUP BY ALL""")
def q_scatter_bins(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_quantity", "l_orderkey % 50 AS k")
    return ch.scatter_bins(rows, "l_quantity", "k", 7)


@query("group_rare_none", "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem")
def q_group_rare_none(spark, d):
    """No value is rare: the type is text all the same."""
    return cat.group_rare_categories(_t(spark, d, "lineitem"), "l_linenumber", 0.0).select("l_orderkey", "l_linenumber")


@query("map_values_numbers", "SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN '1' ELSE l_returnflag END AS l_returnflag FROM lineitem")
def q_map_values_numbers(spark, d):
    return cat.map_values(_t(spark, d, "lineitem"), "l_returnflag", {"A": 1}).select("l_orderkey", "l_returnflag")


@query("bar_grouped_wide_colours", """SELECT l_suppkey, count(*) * 1e9 AS "F", CAST(NULL AS DOUBLE) AS "O"
FROM lineitem WHERE l_suppkey = 1 AND l_linestatus = 'F' GROUP BY 1""")
def q_bar_colours(spark, d):
    """The top supplier has no row of one colour; the colour keeps its column."""
    rows = _t(spark, d, "lineitem").where("l_linestatus = 'F' OR l_suppkey <> 1").selectExpr(
        "l_suppkey", "l_linestatus", "CASE WHEN l_suppkey = 1 THEN 1e9 ELSE l_quantity END AS y")
    return rnd(ch.bar_grouped_wide(rows, "l_suppkey", "y", "l_linestatus", "sum", top_n=1))


@query("formula_text", "SELECT l_orderkey, (l_returnflag = 'A' AND l_quantity > 10) OR l_linestatus IN ('O') AS f FROM lineitem")
def q_formula_text(spark, d):
    t = colops.create_formula_column(_t(spark, d, "lineitem"), "f", "l_returnflag == 'A' & l_quantity > 10 | l_linestatus in ['O']")
    return t.select("l_orderkey", "f")


@query("formula_functions", """SELECT l_orderkey, round(sqrt(l_quantity) + abs(0 - l_tax) + exp(l_discount), 6) AS f,
round(ln(l_quantity), 6) AS g FROM lineitem""")
def q_formula_functions(spark, d):
    t = _t(spark, d, "lineitem").withColumnRenamed("l_quantity", "line quantity")
    t = colops.create_formula_column(t, "f", "sqrt(`line quantity`) + abs(0 - l_tax) + exp(l_discount)")
    return rnd(colops.create_formula_column(t, "g", "log(line quantity)").select("l_orderkey", "f", "g"))


@query("bin_width_label", """SELECT l_orderkey, CASE WHEN l_quantity <= 8 THEN '(0.951, 8.0]'
ELSE '(' || (1 + 7 * ((l_quantity::INTEGER + 5) // 7 - 1))::DOUBLE || ', '
|| (8 + 7 * ((l_quantity::INTEGER + 5) // 7 - 1))::DOUBLE || ']' END AS label FROM lineitem""")
def q_bin_width_label(spark, d):
    t = num.bin_column(_t(spark, d, "lineitem"), "l_quantity", 7, "equal_width", intervals=True)
    return t.select("l_orderkey", F.col("l_quantity_interval").alias("label"))


@query("bin_quantile_label", """WITH e AS (SELECT list_sort(list_distinct([quantile_cont(l_quantity, 0.0), quantile_cont(l_quantity, 0.25),
quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), quantile_cont(l_quantity, 1.0)])) AS e FROM lineitem),
i AS (SELECT l_orderkey, e, 1 + len(list_filter(e[2:len(e) - 1], lambda x: x < l_quantity)) AS i FROM lineitem, e)
SELECT l_orderkey, '(' || CASE WHEN i = 1 THEN round(e[1] - 0.001, 3) ELSE e[i] END || ', ' || e[i + 1] || ']' AS label FROM i""")
def q_bin_quantile_label(spark, d):
    t = num.bin_column(_t(spark, d, "lineitem"), "l_quantity", 4, "quantile", intervals=True)
    return t.select("l_orderkey", F.col("l_quantity_interval").alias("label"))


@query("to_datetime_forms", """SELECT o_orderkey, CASE o_orderkey % 6
WHEN 0 THEN o_orderdate::DATE::TIMESTAMP WHEN 1 THEN o_orderdate::DATE + INTERVAL '10 hours 30 minutes'
WHEN 2 THEN o_orderdate::DATE + INTERVAL '22 hours 30 minutes' WHEN 3 THEN o_orderdate::DATE + INTERVAL '10 hours 30 minutes'
WHEN 4 THEN o_orderdate::DATE::TIMESTAMP ELSE o_orderdate::DATE + INTERVAL '10 hours 30 minutes 5 seconds' END AS t FROM orders""")
def q_to_datetime_forms(spark, d):
    """Compact, T without seconds, AM/PM, month name with time, dots (month first), time with seconds."""
    rows = _t(spark, d, "orders").selectExpr("o_orderkey", """CASE o_orderkey % 6
        WHEN 0 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') || 'T10:30'
        WHEN 2 THEN date_format(o_orderdate, 'MM/dd/yyyy') || ' 10:30 PM' WHEN 3 THEN date_format(o_orderdate, 'MMMM d, yyyy') || ' 10:30'
        WHEN 4 THEN date_format(o_orderdate, 'MM.dd.yyyy') ELSE date_format(o_orderdate, 'MM-dd-yyyy') || ' 10:30:05' END AS t""")
    return conv.convert_to_datetime_mixed(rows, "t")


def _json_documents(spark, df, name: str):
    """Write each row of text as a file of its own to the shared folder, read the files back as a table."""
    path = sio.scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", 1).text(path)
    return sio.read_table(spark, path, "json")


# documents of at most 1,000 customers each
_PACK = "c_custkey div 1000 AS pack"


@query("scan_json_records", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer")
def q_scan_json_records(spark, d):
    rows = _t(spark, d, "customer").selectExpr("c_custkey", "c_name", _PACK).groupBy("pack")
    return _json_documents(spark, rows.agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name"))).alias("t")).select("t"), "records")


@query("scan_json_columns", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer")
def q_scan_json_columns(spark, d):
    rows = _t(spark, d, "customer").selectExpr("struct(c_custkey, c_name) AS x", _PACK).groupBy("pack").agg(F.collect_list("x").alias("x"))
    text = F.to_json(F.struct(F.col("x.c_custkey").alias("c_custkey"), F.col("x.c_name").alias("c_name")))
    return _json_documents(spark, rows.select(text.alias("t")), "columns")


@query("scan_json_single", "SELECT CAST(c_custkey // 1000 AS BIGINT) AS pack, count(*) AS n FROM customer GROUP BY 1")
def q_scan_json_single(spark, d):
    rows = _t(spark, d, "customer").selectExpr(_PACK).groupBy("pack").agg(F.count("*").alias("n"))
    return _json_documents(spark, rows.select(F.to_json(F.struct("pack", "n")).alias("t")), "single")


@query("scan_json_nested", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 2 AS n FROM customer")
def q_scan_json_nested(spark, d):
    """Records with a list cell stay one row each."""
    rows = _t(spark, d, "customer").selectExpr("struct(c_custkey, array(c_name, 'x') AS names) AS x", _PACK).groupBy("pack")
    t = _json_documents(spark, rows.agg(F.to_json(F.collect_list("x")).alias("t")).select("t"), "nested")
    return t.select("c_custkey", F.size("names").alias("n"))


@query("scan_csv_types", """SELECT p_partkey, CAST(CAST(p_partkey AS HUGEINT) + 12345678901234567000 AS VARCHAR) AS big,
p_size > 20 AS flag FROM part""")
def q_scan_csv_types(spark, d):
    """Integers beyond 64 bits and booleans."""
    rows = _t(spark, d, "part").selectExpr("p_partkey", "CAST(p_partkey + CAST(12345678901234567000 AS DECIMAL(20,0)) AS DECIMAL(20,0)) AS big",
                                           "p_size > 20 AS flag")
    t = sio.read_table(spark, sio.write_csv(rows, sio.scratch_path(spark, "types_csv")), "csv")
    return t.select("p_partkey", F.col("big").cast("string").alias("big"), "flag")


@query("type_split", " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{k}' AS \"column\", count({k}) AS n FROM part" for kind, k in (
        ("numeric", "p_partkey"), ("numeric", "p_size"), ("numeric", "p_retailprice"), ("categorical", "p_name"),
        ("categorical", "p_brand"), ("categorical", "p_type"))))
def q_type_split(spark, d):
    """P9 with the count of values of each column."""
    from ..functions.cols import type_split
    df = _t(spark, d, "part")
    kinds = [(kind, k) for kind, names in type_split(df).items() if kind != "all" for k in names]
    one = df.agg(*[F.count(k).alias(k) for _, k in kinds])
    items = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("column"), F.col(k).alias("n")) for kind, k in kinds])
    return one.select(F.explode(items).alias("x")).select("x.*")


@query("rule_roundtrip", SQL["violation_summary"])
def q_rule_roundtrip(spark, d):
    rules = [val.ValidationRule.from_dict(r.to_dict()) for r in _RULES]
    return val.violation_summary(val.validate_rules(dirty_events(spark, d), rules, key_cols="event_id"))


@query("recipe_document", SQL["recipe_replay"])
def q_recipe_document(spark, d):
    steps = recipe.recipe_from_json(recipe.recipe_to_json(RECIPE))
    return rnd(recipe.replay(dirty_events(spark, d), steps))


LOGGED = [
    recipe.make_step("map_values", {"column": "kind", "mapping": {"click": "C", "view": "V"}, "other": True}),
    recipe.make_step("create_column", {"name": "double_value", "formula": "value * 2"}),
    recipe.make_step("rename_column", {"old": "user_id", "new": "user"}),
    recipe.make_step("bin_column", {"column": "user", "bins": 4, "method": "quantile"}),
    recipe.make_step("convert_type", {"target": "Numeric"}, ["double_value"]),
    recipe.make_step("drop_rows", {}, ["value"]),
    recipe.make_step("fill_missing", {"strategy": "drop_columns_by_threshold", "threshold": 50}, ["value"]),
    recipe.make_step("drop_columns", {}, ["ts"]),
]


@query("recipe_logged_names", with_("de") + """, e AS (SELECT list_sort(list_distinct([quantile_cont(user_id, 0.0), quantile_cont(user_id, 0.25),
quantile_cont(user_id, 0.5), quantile_cont(user_id, 0.75), quantile_cont(user_id, 1.0)])) AS e FROM de)
SELECT event_id, user_id AS "user", value, CASE kind WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE 'Other' END AS kind,
round(value * 2, 6) AS double_value, 1 + len(list_filter(e[2:len(e) - 1], lambda x: x < user_id)) AS user_binned
FROM de, e WHERE value IS NOT NULL""")
def q_recipe_logged(spark, d):
    """Step parameters by the names a log of the user interface holds."""
    return rnd(recipe.replay(dirty_events(spark, d), LOGGED))


from . import registry_more  # noqa: E402, F401  (registers its queries in Q and SQL)
