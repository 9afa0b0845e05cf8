"""Further registered queries: values that tables rarely hold (NaN, infinities), free-form dates, mergeable state.

Same contract as ``registry``: whole tables, one DuckDB statement for each query where SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import categorical as cat, chartdata as ch, convert as conv, merged, missing as miss, numeric as num, profile as prof, validate as val
from ..sources import io as sio
from . import observe, recipe
from .registry import _PACK, _RULES, SQL, _json_documents, _t, dirty_events, query, rnd, with_

# events with NaN, a few positive infinities (v) and infinities of both signs (w)
_E3 = ["event_id", "event_type",
       "CASE WHEN event_id % 100 = 5 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 10 = 2 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v",
       "CASE WHEN event_id % 100 = 5 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 100 = 7 THEN CAST('-Infinity' AS DOUBLE) "
       "WHEN event_id % 10 = 2 THEN CAST('NaN' AS DOUBLE) ELSE value END AS w"]
_E3_SQL = "WITH e3 AS (SELECT " + ", ".join(_E3) + " FROM events)"


def infinite_events(spark, d):
    return _t(spark, d, "events").selectExpr(*_E3)


@query("z_stats_inf", _E3_SQL + """
SELECT avg(v) FILTER (NOT isnan(v)) AS mean, CAST(NULL AS DOUBLE) AS std, 3.0 AS threshold, CAST(0 AS BIGINT) AS count, 0.0 AS pct FROM e3""")
def q_z_stats_inf(spark, d):
    return num.detect_outliers_zscore(infinite_events(spark, d), "v")


@query("outlier_flag_inf", _E3_SQL + """, q AS (
  SELECT quantile_cont(w, 0.25) AS q1, quantile_cont(w, 0.75) AS q3 FROM e3 WHERE NOT isnan(w))
SELECT event_id, NOT isnan(w) AND (w < q1 - 1.5 * (q3 - q1) OR w > q3 + 1.5 * (q3 - q1)) AS is_outlier, false AS is_far FROM e3, q""")
def q_outlier_flag_inf(spark, d):
    df = num.flag_outliers(infinite_events(spark, d), "w", "iqr")
    return num.flag_outliers(df, "w", "zscore", flag="is_far").select("event_id", "is_outlier", "is_far")


@query("cap_z_inf", _E3_SQL + " SELECT event_id, CASE WHEN NOT isnan(v) THEN v END AS v FROM e3")
def q_cap_z_inf(spark, d):
    return num.cap_outliers_zscore(infinite_events(spark, d), "v").select("event_id", "v")


@query("drop_outliers_inf", _E3_SQL + " SELECT event_id, event_type FROM e3")
def q_drop_outliers_inf(spark, d):
    return num.remove_outlier_rows(infinite_events(spark, d), "v", "zscore").select("event_id", "event_type")


@query("rule_range_nan", _E3_SQL + """
SELECT event_id, 'v' AS column, 'range' AS rule_type, CASE WHEN isinf(v) THEN 'Infinity' ELSE CAST(v AS VARCHAR) END AS value,
       'Above maximum (300)' AS detail FROM e3 WHERE v > 300 AND NOT isnan(v)
UNION ALL SELECT event_id, 'v', 'range', CAST(v AS VARCHAR), 'Below minimum (1)' FROM e3 WHERE v < 1""")
def q_rule_range_nan(spark, d):
    return val.validate_rules(infinite_events(spark, d), [val.ValidationRule("range", "v", {"min": 1, "max": 300})], key_cols="event_id")


@query("rule_allowed_nan", """
SELECT l_orderkey, l_linenumber, l_partkey, 'x' AS column, 'allowed' AS rule_type, CAST(l_quantity AS VARCHAR) AS value,
       'Not in allowed values: [1.0, 2.0, 3.0]' AS detail FROM lineitem WHERE l_linenumber <> 2 AND l_quantity NOT IN (1, 2, 3)""")
def q_rule_allowed_nan(spark, d):
    x = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    df = _t(spark, d, "lineitem").withColumn("x", x)
    return val.validate_rules(df, [val.ValidationRule("allowed", "x", {"values": [1.0, 2.0, 3.0]})], ["l_orderkey", "l_linenumber", "l_partkey"])


def _hist_inf_sql(grp: str, by: str) -> str:
    """Bins of the finite values as numpy counts them, and the outer bins -1 and 30."""
    return _E3_SQL + f""", f AS (SELECT {grp} AS grp, w FROM e3 WHERE NOT isnan(w)),
r AS (SELECT grp, min(w) FILTER (NOT isinf(w)) AS mn, max(w) FILTER (NOT isinf(w)) AS mx FROM f GROUP BY grp),
p AS (SELECT grp, w, mn, mx, (mx - mn) / 30 AS step,
             CASE WHEN NOT isinf(w) THEN least(CAST(floor((w - mn) * (30 / (mx - mn))) AS INT), 29) END AS i0 FROM f JOIN r USING (grp)),
p1 AS (SELECT *, i0 - CASE WHEN w < i0 * step + mn THEN 1 ELSE 0 END AS i1 FROM p),
c AS (SELECT grp, CASE WHEN isinf(w) AND w > 0 THEN 30 WHEN isinf(w) THEN -1 ELSE
               i1 + CASE WHEN w >= (CASE WHEN i1 + 1 >= 30 THEN mx ELSE (i1 + 1) * step + mn END) AND i1 <> 29 THEN 1 ELSE 0 END END AS bin,
             count(*) AS n FROM p1 GROUP BY ALL),
b AS (SELECT grp, CAST(i AS INT) AS bin, mn, mx, (mx - mn) / 30 AS step FROM r, range(30) AS t(i)
      UNION ALL SELECT grp, bin, mn, mx, NULL FROM c JOIN r USING (grp) WHERE bin IN (-1, 30))
SELECT {by}bin, round(CASE WHEN bin = -1 THEN '-Infinity'::DOUBLE WHEN bin = 30 THEN 'Infinity'::DOUBLE ELSE bin * step + mn END, 6) AS bin_start,
       round(CASE WHEN bin = -1 THEN '-Infinity'::DOUBLE WHEN bin = 30 THEN 'Infinity'::DOUBLE WHEN bin = 29 THEN mx
             ELSE (bin + 1) * step + mn END, 6) AS bin_end, coalesce(n, 0) AS count
FROM b LEFT JOIN c USING (grp, bin)"""


@query("hist_inf", _hist_inf_sql("0", ""))
def q_hist_inf(spark, d):
    return rnd(ch.histogram(infinite_events(spark, d), "w", 30))


@query("hist_grouped_inf", _hist_inf_sql("event_type", 'grp AS "group", '))
def q_hist_grouped_inf(spark, d):
    return rnd(ch.histogram_grouped(infinite_events(spark, d), "w", "event_type", 30))


@query("scatter_bins_inf", """WITH p AS (
  SELECT CASE WHEN l_linenumber = 7 THEN 7 ELSE least((l_quantity::INTEGER - 1) // 7, 6) END AS x_bin,
         CASE WHEN l_returnflag = 'A' THEN -1 ELSE l_linenumber - 1 END AS y_bin FROM lineitem)
SELECT x_bin::INTEGER AS x_bin, y_bin::INTEGER AS y_bin, count(*) AS count FROM p GROUP BY ALL""")
def q_scatter_bins_inf(spark, d):
    df = _t(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("x"),
        F.when(F.col("l_returnflag") == "A", F.lit(float("-inf"))).otherwise(F.col("l_linenumber").cast("double")).alias("y"))
    return ch.scatter_bins(df, "x", "y", 7)


# ---------------------------------------------------------------- T: dates in free form

_MOMENT = "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)"
_FREE = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss'+02:00'", "MMM d, yyyy ha", "MMMM yyyy", "yyyy", "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
         "dd-MMM-yy", "M/d/yy", "yyyyMMdd'T'HHmmss", "d'th' MMMM yyyy", "yyyy-MM-dd HH:mm:ss.SSS '-0530'", "'on' EEEE MMM. d yyyy 'at' h:mm a"]


def free_dates(spark, d):
    """Orders with the moment written in twelve forms."""
    of = F.expr(_MOMENT)
    text = F.date_format(of, _FREE[0])
    for i, form in enumerate(_FREE):
        text = F.when(F.col("o_orderkey") % len(_FREE) == i, F.date_format(of, form)).otherwise(text)
    return _t(spark, d, "orders").select("o_orderkey", text.alias("order_date"))


@query("to_datetime_free", """WITH o AS (
  SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS t FROM orders)
SELECT o_orderkey, CAST(CASE o_orderkey % 12 WHEN 0 THEN t WHEN 1 THEN t - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('hour', t)
  WHEN 3 THEN date_trunc('month', t) WHEN 4 THEN date_trunc('year', t) WHEN 5 THEN t WHEN 6 THEN date_trunc('day', t)
  WHEN 7 THEN date_trunc('day', t) WHEN 8 THEN t WHEN 9 THEN date_trunc('day', t) WHEN 10 THEN t + INTERVAL 330 MINUTE
  ELSE date_trunc('minute', t) END AS TIMESTAMP) AS order_date FROM o""")
def q_to_datetime_free(spark, d):
    return conv.convert_to_datetime_mixed(free_dates(spark, d), "order_date")


@query("to_datetime_auto_zone", """WITH o AS (
  SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS t FROM orders)
SELECT o_orderkey, CAST(CASE WHEN o_orderkey <> (SELECT min(o_orderkey) FROM orders) AND o_orderkey % 7 = 5 THEN NULL
  WHEN o_orderkey % 3 = 0 THEN t WHEN o_orderkey % 3 = 1 THEN t - INTERVAL 2 HOUR ELSE t + INTERVAL 330 MINUTE END AS TIMESTAMP) AS order_date FROM o""")
def q_to_datetime_auto_zone(spark, d):
    """The first value has a zone, so the guessed format asks for one; values without it become null."""
    df = _t(spark, d, "orders")
    first = df.agg(F.min("o_orderkey")).first()[0]
    k = F.col("o_orderkey")
    zone = F.when((k != first) & (k % 7 == 5), "").when(k % 3 == 0, "Z").when(k % 3 == 1, "+02:00").otherwise("-0530")
    text = F.concat(F.date_format(F.expr(_MOMENT), "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return conv.convert_to_datetime(df.select("o_orderkey", text.alias("order_date")), "order_date", order_by="o_orderkey")


@query("to_datetime_fmt_parts", """WITH o AS (
  SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS t FROM orders)
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE t - INTERVAL 90 MINUTE END AS TIMESTAMP) AS order_date FROM o""")
def q_to_datetime_fmt_parts(spark, d):
    """Day of the year, weekday, hour with AM or PM, and zone in a given format; hour 13 to 23 with them is no time."""
    form = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(F.expr(_MOMENT), "EEEE yyyy DDD '14':mm:ss a")).otherwise(
        F.date_format(F.expr(_MOMENT), "EEEE yyyy DDD hh:mm:ss a"))
    df = _t(spark, d, "orders").select("o_orderkey", F.concat(form, F.lit(" +01:30")).alias("order_date"))
    return conv.convert_to_datetime(df, "order_date", "%A %Y %j %I:%M:%S %p %z")


# ---------------------------------------------------------------- counts observed while a chain runs

_WIDE = [{"operation": "drop_rows", "columns": ["kind"]},
         {"operation": "fill_missing", "params": {"strategy": "ffill", "order_by": "event_id"}, "columns": ["value"]},
         {"operation": "standardize_categorical", "params": {"operations": ["trim", "lower"]}, "columns": ["kind"]},
         {"operation": "remove_duplicates", "params": {"subset": ["user_id", "kind"], "order_by": "event_id"}},
         {"operation": "drop_columns", "columns": ["ts"]}]
_WIDE_SQL = with_("de") + """, s1 AS (SELECT * FROM de WHERE kind IS NOT NULL),
s2 AS (SELECT event_id, ts, user_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS value, kind FROM s1),
s3 AS (SELECT event_id, ts, user_id, value, CASE WHEN lower(trim(kind)) NOT IN ('', 'nan', 'none', 'null') THEN lower(trim(kind)) END AS kind FROM s2),
s4 AS (SELECT * FROM s3 QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) = 1),
m AS (SELECT 0 AS step, count(*) AS n, count(*) FILTER (value IS NULL) + count(*) FILTER (kind IS NULL) AS m FROM de
  UNION ALL SELECT 1, count(*), count(*) FILTER (value IS NULL) + count(*) FILTER (kind IS NULL) FROM s1
  UNION ALL SELECT 2, count(*), count(*) FILTER (value IS NULL) + count(*) FILTER (kind IS NULL) FROM s2
  UNION ALL SELECT 3, count(*), count(*) FILTER (value IS NULL) + count(*) FILTER (kind IS NULL) FROM s3
  UNION ALL SELECT 4, count(*), count(*) FILTER (value IS NULL) + count(*) FILTER (kind IS NULL) FROM s4
  UNION ALL SELECT 5, count(*), count(*) FILTER (value IS NULL) + count(*) FILTER (kind IS NULL) FROM s4)
SELECT a.step, ['drop_rows', 'fill_missing', 'standardize_categorical', 'remove_duplicates', 'drop_columns'][a.step] AS operation,
       b.n AS rows_before, a.n AS rows_after, 5 AS columns_before, CASE WHEN a.step = 5 THEN 4 ELSE 5 END AS columns_after,
       b.m AS missing_cells_before, a.m AS missing_cells_after, 'event_id,ts,user_id,value,kind' AS column_names_before,
       CASE WHEN a.step = 5 THEN 'event_id,user_id,value,kind' ELSE 'event_id,ts,user_id,value,kind' END AS column_names_after
FROM m a JOIN m b ON a.step = b.step + 1"""


@query("audit_report_wide", _WIDE_SQL)
def q_audit_wide(spark, d):
    return recipe.audit_report(dirty_events(spark, d), _WIDE)


@query("before_after_nulls_observed", SQL["before_after_nulls"])
def q_before_after_observed(spark, d):
    return observe.before_after_nulls(dirty_events(spark, d), lambda df: miss.fill_missing(df, ["value"], "mean"))


@query("violation_summary_observed", SQL["violation_summary"])
def q_violations_observed(spark, d):
    found = observe.CountedViolations(dirty_events(spark, d), _RULES, key_cols="event_id")
    found.violations.write.format("noop").mode("overwrite").save()
    return found.summary()


# ---------------------------------------------------------------- S: files cut at record borders

@query("scan_csv_line_breaks", "SELECT doc_id, nullif(text, '') AS text, source, n_chars FROM documents")
def q_scan_csv_line_breaks(spark, d):
    """Texts of many lines, written as quoted fields and read back from byte ranges."""
    docs = _t(spark, d, "documents").select("doc_id", "text", "source", "n_chars")
    return sio.read_table(spark, sio.write_csv(docs, sio.scratch_path(spark, "texts_csv")), "csv")


@query("scan_json_mixed", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CASE WHEN c_custkey // 1000 % 2 = 0 THEN '}],\"{' END AS mark FROM customer")
def q_scan_json_mixed(spark, d):
    """A folder that holds documents of records and documents of columns."""
    rows = _t(spark, d, "customer").selectExpr("struct(c_custkey, c_name, '}],\"{' AS mark) AS x", _PACK).groupBy("pack").agg(F.collect_list("x").alias("x"))
    columns = F.to_json(F.struct(F.col("x.c_custkey").alias("c_custkey"), F.col("x.c_name").alias("c_name")))
    text = F.when(F.col("pack") % 2 == 0, F.to_json("x")).otherwise(columns)
    return _json_documents(spark, rows.select(text.alias("t")), "mixed")


# ---------------------------------------------------------------- F: context rows, top values of large columns

@query("dataset_context_rows", with_("de") + """, f AS (SELECT * FROM de ORDER BY event_id LIMIT 7),
r AS (SELECT *, row_number() OVER (ORDER BY event_id)::INTEGER AS row FROM f)
SELECT row, 0 AS ordinal, 'event_id' AS column, CAST(event_id AS VARCHAR) AS value FROM r
UNION ALL SELECT row, 2, 'user_id', CAST(user_id AS VARCHAR) FROM r UNION ALL SELECT row, 4, 'kind', kind FROM r
UNION ALL SELECT row, 1, 'day', strftime(ts, '%Y-%m-%d') FROM r UNION ALL SELECT row, 3, 'missing', CASE WHEN value IS NULL THEN 'yes' END FROM r""")
def q_context_rows(spark, d):
    df = dirty_events(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id",
                                       F.when(F.col("value").isNull(), "yes").alias("missing"), "kind")
    return prof.context_rows(df, 7, order_by="event_id")


@query("dataset_context_documents", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{k}' AS column, CAST({k} AS VARCHAR) AS v, CAST({'doc_id' if k == 'doc_id' else 'NULL'} AS DOUBLE) AS x FROM documents"
    for i, k in enumerate(["doc_id", "text", "lang", "source"])) + """),
g AS (SELECT ordinal, "column", v, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY ALL),
t AS (SELECT ordinal, string_agg(v, ', ' ORDER BY n DESC, v) AS top_values FROM (
  SELECT * FROM g WHERE ordinal > 0 QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, v) <= 3) GROUP BY ordinal)
SELECT "column", count(*) FILTER (v IS NULL) AS null_count, count(DISTINCT v) AS unique_count, any_value(top_values) AS top_values, ordinal
FROM c LEFT JOIN t USING (ordinal) GROUP BY ordinal, "column\"""")
def q_context_documents(spark, d):
    """Whole texts among the columns: their values are told apart by fingerprints."""
    t = prof.dataset_context(_t(spark, d, "documents").select("doc_id", "text", "lang", "source"), top_n=3)
    return t.select("column", "null_count", "unique_count", "top_values", "ordinal")


@query("top_values_open", "SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY l_partkey "
                          "ORDER BY count(*) DESC, l_partkey LIMIT 20")
def q_top_values_open(spark, d):
    """Many values of nearly equal frequency."""
    return prof.top_values(_t(spark, d, "lineitem"), "l_partkey", 20)


# ---------------------------------------------------------------- C, F, H: lookup tables, merged profiles, wide correlations

@query("map_values_table", "SELECT l_orderkey, l_linenumber, coalesce('name of ' || s_name, CAST(l_suppkey AS VARCHAR)) AS l_suppkey "
                           "FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 3 > 0")
def q_map_values_table(spark, d):
    """A map that is a table of its own."""
    names = _t(spark, d, "supplier").where("s_suppkey % 3 > 0").select("s_suppkey", F.concat(F.lit("name of "), "s_name").alias("name"))
    return cat.map_values(_t(spark, d, "lineitem"), "l_suppkey", names).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("map_values_table_other", "SELECT l_orderkey, l_linenumber, coalesce(s_name, 'Other') AS l_suppkey "
                                 "FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 3 > 0")
def q_map_values_table_other(spark, d):
    names = _t(spark, d, "supplier").where("s_suppkey % 3 > 0").select("s_suppkey", "s_name")
    return cat.map_values(_t(spark, d, "lineitem"), "l_suppkey", names, True).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("profile_merged", " UNION ALL ".join(
    f"SELECT '{k}' AS column, count({k}) AS non_null_count, count(*) - count({k}) AS null_count, "
    + (f"round(min({k}), 6) AS min, round(max({k}), 6) AS max, " if n else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, ")
    + f"true AS near, {i} AS ordinal FROM events" for i, (k, n) in enumerate([("event_id", 1), ("user_id", 1), ("event_type", 0), ("value", 1)])))
def q_profile_merged(spark, d):
    """States of seven parts, merged; near: the estimate is within 8 % (five standard errors) of the exact distinct count."""
    df = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    states = None
    for i in range(7):
        part = merged.profile_state(df.where(F.col("event_id") % 7 == i))
        states = part if states is None else states.unionByName(part)
    exact = prof.column_profile(df).select("column", F.col("unique_count").alias("exact"))
    t = merged.profile_of(states).join(exact, "column")
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 0.08 * F.col("exact")
    return rnd(t.select("column", "non_null_count", "null_count", "min", "max", near.alias("near"), "ordinal"))


_WIDE_COLS = [(f"c{i}", f"l_quantity * {i % 7} + l_extendedprice * {(i * 3) % 11} / 1000 + l_discount * {(i * 5) % 13} * 100 + l_linenumber")
              for i in range(48)]


@query("corr_matrix_wide", "WITH w AS (SELECT " + ", ".join(
    f"CASE WHEN l_orderkey % {i + 5} <> 0 THEN {e} END AS {k}" for i, (k, e) in enumerate(_WIDE_COLS)) + " FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM w" for a, _ in _WIDE_COLS for b, _ in _WIDE_COLS))
def q_corr_wide(spark, d):
    """48 columns, each with its own missing cells: 2,304 pairs."""
    df = _t(spark, d, "lineitem").selectExpr(*[f"CASE WHEN l_orderkey % {i + 5} <> 0 THEN {e} END AS {k}" for i, (k, e) in enumerate(_WIDE_COLS)])
    return rnd(ch.correlation_matrix(df))
