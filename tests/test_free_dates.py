"""Free-form dates against pandas (format="mixed"), and the forms a given or guessed format may hold."""

import warnings
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spruce import convert_to_datetime, convert_to_datetime_mixed
from spruce.functions import freedates

DAYS = ["2024-06-25", "2024/6/5", "2024.06.25", "25.06.2024", "13/06/2024", "06/13/2024", "6/5/24", "25-Jun-24", "25 Jun 2024", "25 June 2024",
        "Jun 25, 2024", "June 25 2024", "Jun. 25, 2024", "25th June 2024", "June 2nd, 2024", "Tue, 25 Jun 2024", "Tuesday, June 25, 2024",
        "2024 Jun 25", "2024-Jun-25", "20240625", "99-01-02", "31/12/99", "Sept 5 2024", "12-25-2024", "2024-6-5"]
TIMES = ["", " 10:11", " 10:11:12", "T10:11:12", " 10:11:12.5", " 3pm", " 3 PM", " 10:11 AM", " 10:11:12 pm", " 12:05 am", "T10:11:12Z",
         " 10:11:12+02:00", " 10:11:12 -0530", " 10:11 UTC", " 10:11:12 GMT", " 10:11:12 EST", " at 10:00", " 24:00", " 10:60", " 13:00 PM"]
OTHERS = ["June 2024", "2024", "2024-06", "06/2024", "Jun-24", "25 June", "June 25", "2024-13-05", "2024-02-30", "30 Feb 2024", "20240625T101112",
          "20240625T1011", "20240625101112", "202406251011", "202406", "240625", "250624", "2024-177", "2024-W26-2", "noon", "nan", "null", "",
          "1719310000", "1.5", "Tue Jun 25 10:00:00 2024", "Tue Jun 25 10:00:00 UTC 2024", "10:11:12 2024-06-25", "12:30 25/06/2024",
          "3pm June 25 2024", "2024June25", "2024-06-25 10h11m12s", "2024-06-25 10h", "00/01/2024", "2024-06-25T", "2024-06-25T10", "a 2024",
          "june", "12", "0", "2024Q1", "2024-Q3", "2024/13/05", "25/13/2024", "Jan 2024 5", "2024 5 Jan", "5 2024 Jan", "10 Jan 24", "Jan 10 24",
          "24 Jan 10", "99 Jan 10", "x2024-06-25", "2024-06-25x", "2024-06-25 foo", "2024-06-25 10:11 foo", "2024 06 25", "06 25 2024",
          "25/06/24 10:11", "5.6.24", "Monday 2024-06-24", "12th of June 2024", "1/2", "1/2/3", "31/2/2024", "Feb 29 2023", "Feb 29 2024",
          "2024-06-25T10:11:12+0200", "2024-06-25T10:11:12+02", "2024-06-25T10:11:12.123456789Z", "  2024-06-25  ", "25jun2024", "a|b 2024"]


def by_pandas(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        t = pd.to_datetime(pd.Series([text]), format="mixed", errors="coerce")[0]
    if pd.isna(t):
        return None
    return (t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t).floor("us").to_pydatetime()


def test_mixed_equals_pandas(spark):
    forms = [d + t for d in DAYS for t in TIMES] + OTHERS
    df = spark.createDataFrame(list(enumerate(forms)), "i int, x string")
    got = {r.i: r.x for r in convert_to_datetime_mixed(df, "x").collect()}
    assert len(forms) > 500 and {f: got[i] for i, f in enumerate(forms)} == {f: by_pandas(f) for f in forms}


def test_automaton_alone_reads_the_plain_forms(spark):
    """Without the quick shapes in front of it."""
    forms = [d + t for d in DAYS for t in TIMES]
    df = spark.createDataFrame(list(enumerate(forms)), "i int, x string").select("i", freedates.parse_free(F.col("x")).alias("x"))
    assert {forms[r.i]: r.x for r in df.collect()} == {f: by_pandas(f) for f in forms}


def test_years_of_two_digits_are_near(spark):
    df = spark.createDataFrame([("1/2/70",), ("1/2/25",), ("1/2/24",), ("1/2/75",)], "x string")
    got = [r.x.year for r in df.select(freedates.parse_free(F.col("x"), this_year=2024).alias("x")).collect()]
    assert got == [2070, 2025, 2024, 1975]


@pytest.mark.parametrize("fmt,text,want", [
    ("%I:%M %p %d/%m/%Y", "03:05 PM 02/01/2024", datetime(2024, 1, 2, 15, 5)), ("%I:%M %p %d/%m/%Y", "13:05 PM 02/01/2024", None),
    ("%I:%M %p %d/%m/%Y", "12:05 am 02/01/2024", datetime(2024, 1, 2, 0, 5)), ("%Y %j", "2024 366", datetime(2024, 12, 31)),
    ("%Y %j", "2023 366", None), ("%Y %j", "2023 0", None), ("%A %d %b %Y", "monday 3 Jun 2024", datetime(2024, 6, 3)),
    ("%A %d %b %Y", "funday 3 Jun 2024", None), ("%Y-%m-%d %H:%M%z", "2024-01-01 00:30+0100", datetime(2023, 12, 31, 23, 30)),
    ("%Y-%m-%d %H:%M%z", "2024-01-01 00:30Z", datetime(2024, 1, 1, 0, 30)), ("%Y-%m-%d %H:%M%z", "2024-01-01 00:30", None)])
def test_directives_of_a_given_format(spark, fmt, text, want):
    df = spark.createDataFrame([(text,), (None,)], "x string")
    assert [r.x for r in convert_to_datetime(df, "x", fmt).collect()] == [want, None]


def test_guess_with_zone_and_fall_back(spark):
    df = spark.createDataFrame([(1, "2024-06-25T10:11:12Z"), (2, "2024-06-25T10:11:12+02:00"), (3, "2024-06-25T10:11:12")], "i int, x string")
    got = [r.x for r in convert_to_datetime(df, "x", order_by="i").orderBy("i").collect()]
    assert got == [datetime(2024, 6, 25, 10, 11, 12), datetime(2024, 6, 25, 8, 11, 12), None]
    df = spark.createDataFrame([(1, "Jun 25, 2024 3pm"), (2, "2024-06-25"), (3, "x")], "i int, x string")
    got = [r.x for r in convert_to_datetime(df, "x", order_by="i").orderBy("i").collect()]
    assert got == [datetime(2024, 6, 25, 15), datetime(2024, 6, 25), None]
