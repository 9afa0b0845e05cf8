"""strftime-style date parsing as native Spark expressions.

``to_timestamp``/``try_to_timestamp`` parse in the session time zone, so a
local time that does not exist there (a DST gap) is moved.  Parsing here is
zone-free instead: a regex checks the whole text against the format, the
parts are rearranged to ``yyyy-MM-dd HH:mm:ss.SSSSSS`` and cast to
``timestamp_ntz`` with ``try_cast`` (an impossible date such as 31/02 gives
null).
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .freedates import MONTHS, WEEKDAYS, hour_of, parse_free, zone_minutes

# Formats tried, in this order, when a column's format is
# guessed from its first value (month-first before day-first, for every separator).
GUESS_FORMATS = [
    "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y/%m/%d",
    "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M",
    "%d/%m/%Y", "%m-%d-%Y %H:%M:%S", "%m-%d-%Y %H:%M", "%m-%d-%Y", "%d-%m-%Y %H:%M:%S", "%d-%m-%Y %H:%M", "%d-%m-%Y",
    "%m.%d.%Y %H:%M:%S", "%m.%d.%Y %H:%M", "%m.%d.%Y", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d.%m.%Y", "%Y%m%d",
    "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S.%f%z", "%Y-%m-%dT%H:%M%z", "%Y-%m-%d %H:%M%z",
    "%Y-%m-%d %I:%M %p", "%Y-%m-%d %I:%M:%S %p", "%m/%d/%Y %I:%M %p", "%m/%d/%Y %I:%M:%S %p", "%d/%m/%Y %I:%M %p", "%d/%m/%Y %I:%M:%S %p",
    "%d %b %Y", "%d %B %Y", "%b %d %Y", "%B %d %Y", "%b %d, %Y", "%B %d, %Y",
]

# Shapes of the mixed parser: an optional time follows each.
_TIME = r"(?:[T\s]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?\s*([AaPp][Mm])?)?\s*$"
_YEAR_FIRST = r"^\s*(\d{4})[-/.]?(\d{2}|(?<=[-/.])\d)[-/.]?(\d{2}|(?<=[-/.])\d)" + _TIME
_NUMBER_FIRST = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _TIME
_DAY_NAME = r"^\s*(\d{1,2})[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4})" + _TIME
_NAME_DAY = r"^\s*([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:,\s*|\s+)(\d{4})" + _TIME

_FIELDS = {
    "Y": ("year", r"(\d{4})"),
    "y": ("year2", r"(\d{2})"),
    "m": ("month", r"(\d{1,2})"),
    "d": ("day", r"(\d{1,2})"),
    "H": ("hour", r"(\d{1,2})"),
    "M": ("minute", r"(\d{1,2})"),
    "S": ("second", r"(\d{1,2})"),
    "f": ("fraction", r"(\d{1,6})"),
    "b": ("month_abbr", r"([A-Za-z]{3})"),
    "B": ("month_name", r"([A-Za-z]+)"),
    "I": ("hour12", r"(\d{1,2})"),
    "p": ("half", r"([AaPp][Mm])"),
    "j": ("day_of_year", r"(\d{1,3})"),
    "A": ("weekday", "((?i:" + "|".join(WEEKDAYS) + "))"),
    "a": ("weekday", "((?i:" + "|".join(d[:3] for d in WEEKDAYS) + "))"),
    "z": ("zone", r"(Z|[+-]\d{2}:?\d{2})"),
}


def compile_format(fmt: str) -> tuple[str, list[str]]:
    """strftime format -> (anchored regex, list of field names by group)."""
    out, fields, i = [], [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%" and i + 1 < len(fmt):
            code = fmt[i + 1]
            i += 2
            if code == "%":
                out.append("%")
            elif code in _FIELDS:
                name, rx = _FIELDS[code]
                out.append(rx)
                fields.append(name)
            else:
                raise ValueError(f"unsupported date directive %{code} in {fmt!r}")
        elif ch.isspace():
            out.append(r"\s+")
            i += 1
        else:
            out.append(re.escape(ch))
            i += 1
    return "^\\s*" + "".join(out) + "\\s*$", fields


def _month_from_name(part: Column, abbr: bool) -> Column:
    p = F.lower(part)
    if abbr:
        names = F.array(*[F.lit(m[:3]) for m in MONTHS])
        return F.array_position(names, p)
    full = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), p)
    # %B also accepts the three-letter form, as strptime does.
    short = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), p)
    return F.when(full > 0, full).otherwise(short)


_DIRECT = {"year", "month", "day", "hour", "minute", "second", "fraction"}


def parse_with_format(x: Column, fmt: str) -> Column:
    """Text -> timestamp_ntz under one strftime format; null when it does not fit."""
    rx, fields = compile_format(fmt)
    s = x.cast("string")
    if set(fields) <= _DIRECT:
        # One regex pass rewrites the text to ISO form (the cast accepts
        # unpadded fields); the guard keeps non-matching text out.
        ref = {name: f"${i + 1}" for i, name in enumerate(fields)}
        template = (f"{ref.get('year', '1900')}-{ref.get('month', '1')}-{ref.get('day', '1')} "
                    f"{ref.get('hour', '0')}:{ref.get('minute', '0')}:{ref.get('second', '0')}"
                    + (f".{ref['fraction']}" if "fraction" in ref else ""))
        return F.when(s.rlike(rx), F.regexp_replace(s, rx, template).try_cast("timestamp_ntz"))
    part = {name: F.regexp_extract(s, rx, i + 1) for i, name in enumerate(fields)}
    if "year" in part:
        year = part["year"]
    elif "year2" in part:
        yy = part["year2"].cast("int")
        year = F.when(yy < 69, yy + 2000).otherwise(yy + 1900).cast("string")
    else:
        year = F.lit("1900")
    if "month" in part:
        month = part["month"]
    elif "month_abbr" in part:
        month = _month_from_name(part["month_abbr"], True).cast("string")
    elif "month_name" in part:
        month = _month_from_name(part["month_name"], False).cast("string")
    else:
        month = F.lit("1")
    day = part.get("day", F.lit("1"))
    if "hour12" in part:  # 1 to 12; without %p before noon
        h = part["hour12"].try_cast("int")
        half = F.substring(F.lower(part["half"]), 1, 1) if "half" in part else F.lit("a")
        hour = F.when(h.between(1, 12), hour_of(part["hour12"], half)).otherwise(99).cast("string")
    else:
        hour = part.get("hour", F.lit("0"))
    minute = part.get("minute", F.lit("0"))
    second = part.get("second", F.lit("0"))
    frac = F.rpad(part["fraction"], 6, "0") if "fraction" in part else F.lit("000000")

    def two(v: Column) -> Column:
        return F.lpad(v, 2, "0")

    iso = F.concat(F.lpad(year, 4, "0"), F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "),
                   two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit("."), frac)
    ok = s.rlike(rx)
    if "month_abbr" in part or "month_name" in part:
        ok = ok & (month.cast("int") > 0)
    moment = iso.try_cast("timestamp_ntz")
    if "day_of_year" in part:  # %j says the day, whatever month and day are given
        first = F.concat(F.lpad(year, 4, "0"), F.lit("-01-01"), F.substring(iso, 11, 32)).try_cast("timestamp_ntz")
        that = first + F.make_dt_interval(days=part["day_of_year"].try_cast("int") - 1)
        moment = F.when((F.year(that) == F.year(first)) & (part["day_of_year"].try_cast("int") > 0), that)
    if "zone" in part:  # the moment in UTC
        moment = moment - F.make_dt_interval(mins=zone_minutes(F.lower(part["zone"])))
    return F.when(ok, moment)


def parse_mixed(x: Column, formats: list[str] | None = None) -> Column:
    """Each value parsed on its own: by the formats given, else by its shape.

    The shapes are year first, numbers first (month first; day first only
    where the first number cannot be a month) and month name; each takes one regex pass.
    What fits none of them goes to the token automaton of :mod:`freedates`.
    """
    if formats:
        return F.coalesce(*[parse_with_format(x, f) for f in formats])
    s = x.cast("string")

    def rewritten(kind: str, shape: str) -> Column:
        return F.regexp_replace(s, shape, kind + "|$1|$2|$3|$4|$5|$6|$7|$8")

    # one rewrite for each value, chosen by how the text begins; what does not fit its shape stays as it is
    canonical = (F.when(s.rlike(r"^\s*\d{4}"), rewritten("Y", _YEAR_FIRST))
                 .when(s.rlike(r"^\s*\d{1,2}[-/.]\d"), rewritten("N", _NUMBER_FIRST))
                 .when(s.rlike(r"^\s*\d"), rewritten("D", _DAY_NAME)).otherwise(rewritten("M", _NAME_DAY)))

    def moment(p: Column) -> Column:
        """p: kind, three date parts in the order of the text, hour, minute, second, fraction, AM or PM."""
        kind, half = p[0], F.lower(p[8])
        swap = (kind == "N") & (p[1].try_cast("int") > 12)  # the first number cannot be a month
        year = F.when(kind == "Y", p[1]).otherwise(p[3])
        month = F.when((kind == "Y") | (kind == "D") | swap, p[2]).otherwise(p[1])
        day = F.when(kind == "Y", p[3]).when((kind == "D") | swap, p[1]).otherwise(p[2])
        month = F.when((kind == "D") | (kind == "M"), F.nullif(_month_from_name(month, False), F.lit(0)).cast("string")).otherwise(month)
        hour = F.coalesce(p[4].try_cast("int"), F.lit(0))
        hour = F.when(half == "", hour).when(~hour.between(1, 12), F.lit(99)).otherwise(
            hour % 12 + F.when(half == "pm", 12).otherwise(0))
        zero = lambda c: F.when(c == "", F.lit("0")).otherwise(c)
        text = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), hour.cast("string"), F.lit(":"), zero(p[5]),
                        F.lit(":"), zero(p[6]), F.lit("."), F.substring(F.rpad(p[7], 6, "0"), 1, 6))
        return F.when((F.size(p) == 9) & kind.isin("Y", "N", "D", "M"), text.try_cast("timestamp_ntz"))

    # an array of one, so that the parts are made once and used many times
    return F.coalesce(F.transform(F.array(F.split(canonical, r"\|", -1)), moment)[0], parse_free(x))


def guess_format(sample: str | None) -> str | None:
    """The format of one sample text, or None (month-first on ambiguity)."""
    if sample is None:
        return None
    text = str(sample).strip()
    for fmt in GUESS_FORMATS:
        rx, _ = compile_format(fmt)
        if not re.match(rx, text):
            continue
        try:
            datetime.strptime(re.sub(r"\s+", " ", text), fmt)
        except ValueError:
            continue
        return fmt
    return None
