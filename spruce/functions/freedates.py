"""Free-form dates as native expressions: a token automaton.

A text is read in three steps, each one expression over the result of the step before:

1. what says nothing is taken out (weekday names, ``st nd rd th`` behind a number, ``at on and of``);
2. the time is cut out wherever it stands: hours and minutes, with seconds, fraction, AM or PM and zone, or hours with AM or PM,
   compact (``T101112``) or with letters (``10h11m``);
3. what is left is split into numbers and month names, and the string of their classes picks the order of the
   parts: n is a number of one or two digits, Y of four, M a month name, e and s dates of eight and six digits.  Any
   other class is no date.

Numbers alone are month, day, year; a first number over 12 is the day, one over 31 the year.  A year of two digits is
the one within 50 years of ``this_year``.  Month and year are the first of the month, a year alone its first day.
A zone (``Z``, ``UTC``, ``GMT``, ``+02:00``, ``-0530``, ``+02``) moves the moment to UTC, as the result has no zone; other
zone names in capitals are read over.  A time without a date is null.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names (also by their first three letters), weekday names (also by three), and words without meaning.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
FILLERS = ["at", "on", "and", "of", "ad"]
MONTH_NUMBERS = {**{m: i + 1 for i, m in enumerate(MONTHS)}, **{m[:3]: i + 1 for i, m in enumerate(MONTHS)}, "sept": 9}

# a zone's name behind a time, in capitals; it is read over
_NAMED_ZONE = r"(:\d{2}(?:\.\d+)?\s*(?:[AaPp]\.?[Mm]\.?)?\s+)(?!UTC|GMT|" + "|".join(m[:3].upper() for m in MONTHS) + r")[A-Z]{3,5}(?![A-Za-z])"
_ZONE = r"(z|utc|gmt|[+-]\d{2}:?\d{2}|[+-]\d{1,2}(?![\d:]))?"
_BEFORE = r"^(.*?)(?:^|(?<=\d)t|[\s,])\s*"
_AFTER = r"(|[\s,].*)$"
_HALF = r"(?:([ap])\.?m\.?(?![a-z]))?"
# what to look for, and how the text is rewritten to date|hour|minute|second|fraction|half|zone
_TIMES = [
    (r"\d:\d", _BEFORE + r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*" + _HALF + r"\s*" + _ZONE + _AFTER, "$1 $8|$2|$3|$4|$5|$6|$7"),
    (r"\d\s*[ap]\.?m", _BEFORE + r"(\d{1,2})\s*([ap])\.?m\.?\s*" + _ZONE + _AFTER, "$1 $5|$2||||$3|$4"),
    (r"\dt\d", r"^(.*?\d)t(\d{2})(?:(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?\s*" + _ZONE + "()$", "$1|$2|$3|$4|$5||$6"),
    (r"\d\s*h", _BEFORE + r"(\d{1,2})h(?:(\d{1,2})m(?:in)?)?(?:(\d{1,2})s)?" + _AFTER, "$1 $5|$2|$3|$4|||"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{4}$", r"^(.*) (\d{2})(\d{2})$", "$1|$2|$3||||"),
    (r"^(\d{12}|\d{14})$", r"^(\d{8})(\d{2})(\d{2})(\d{2})?$", "$1|$2|$3|$4|||"),
]
# class string -> places of year, month and day among the parts (0: not given)
_ORDERS = {"Ynn": (1, 2, 3), "MnY": (3, 1, 2), "Mnn": (3, 1, 2), "MYn": (2, 1, 3), "nMY": (3, 2, 1), "nMn": (3, 2, 1), "YMn": (1, 2, 3),
           "YnM": (1, 3, 2), "nYM": (2, 3, 1), "nnM": (1, 3, 2), "MY": (2, 1, 0), "YM": (1, 2, 0), "nY": (2, 1, 0), "Yn": (1, 2, 0),
           "Y": (1, 0, 0)}


def let(x: Column, use) -> Column:
    """``use(x)`` with x computed once."""
    return F.transform(F.array(x), use)[0]


def zone_minutes(zone: Column) -> Column:
    """Minutes east of UTC of a zone's text in lower case; 0 for names."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours = F.substring(digits, 1, 2).try_cast("int")
    size = hours * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    return F.when(zone.startswith("-"), -size).when(zone.startswith("+"), size).otherwise(F.lit(0))


def month_number(name: Column) -> Column:
    """1 to 12 for a month's name in lower case, else null."""
    names = F.create_map(*[F.lit(x) for kv in MONTH_NUMBERS.items() for x in kv])
    return F.try_element_at(names, name)


def full_year(year: Column, this_year: int) -> Column:
    """A year of two digits within 50 years of ``this_year``."""
    near = year + this_year // 100 * 100
    return F.when(near >= this_year + 50, near - 100).when(near < this_year - 50, near + 100).otherwise(near)


def hour_of(hour: Column, half: Column) -> Column:
    """Hour of the day from an hour's text and a or p; 99, which no time has, if the two do not fit."""
    h = F.coalesce(hour.try_cast("int"), F.lit(0))
    return F.when(half == "", h).when(~h.between(0, 12), F.lit(99)).otherwise(h % 12 + F.when(half == "p", 12).otherwise(0))


def _date_text(tokens: Column, this_year: int) -> Column:
    """year-month-day of the parts, or null."""
    def part_class(x):
        return (F.when(x.rlike(r"^\d{1,2}$"), "n").when(x.rlike(r"^\d{4}$"), "Y").when(x.rlike(r"^\d{8}$"), "e")
                .when(x.rlike(r"^\d{6}$"), "s").when(month_number(x).isNotNull(), "M").otherwise("x"))

    def number(x):
        return F.coalesce(x.try_cast("int"), month_number(x))

    def text(y, m, d):
        year = F.when(F.length(y) == 2, full_year(y.try_cast("int"), this_year)).otherwise(y.try_cast("int"))
        return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), m.cast("string"), F.lit("-"), d.cast("string"))

    def numbers(a, b, c):  # three numbers; the last is the year unless the first must be
        first = a.try_cast("int")
        pad = lambda x: F.lpad(x, F.greatest(F.length(x), F.lit(2)), F.lit("0"))
        return F.when(first > 31, text(pad(a), b, c)).when(first > 12, text(pad(c), b, a)).otherwise(text(pad(c), a, b))

    def of(kind):
        at = lambda i: F.get(tokens, F.lit(i - 1)) if i else F.lit("1")
        out = F.when(kind.isin("nnY", "nnn"), numbers(at(1), at(2), at(3)))
        part = lambda x, i: F.substring(x, i, 2)
        out = out.when(kind == "e", text(F.substring(at(1), 1, 4), part(at(1), 5), part(at(1), 7)))
        out = out.when(kind == "s", numbers(part(at(1), 1), part(at(1), 3), part(at(1), 5)))
        out = out.when((kind == "nMn") & (number(at(1)) > 31), text(at(1), number(at(2)), number(at(3))))
        for k, (y, m, d) in _ORDERS.items():
            year = at(y) if "Y" in k else F.lpad(at(y), 2, "0")
            out = out.when(kind == k, text(year, number(at(m)), number(at(d))))
        return out

    return let(F.array_join(F.transform(tokens, part_class), ""), of)


def parse_free(x: Column, this_year: int | None = None) -> Column:
    """Text in any of the forms above -> timestamp_ntz; null where it is none."""
    year = this_year or date.today().year
    days = "|".join(rf"{d[:3]}(?:{d[3:]})?" for d in WEEKDAYS)
    t = F.lower(F.trim(F.regexp_replace(x.cast("string"), _NAMED_ZONE, "$1")))
    t = F.regexp_replace(t, rf"(?<![a-z])(?:{days}|{'|'.join(FILLERS)})(?![a-z])[.,]?", " ")
    t = F.regexp_replace(t, r"(?<=\d)(?:st|nd|rd|th)(?![a-z])", "")
    t = F.trim(F.regexp_replace(t, r"^(\d{1,2})([a-z]{3,9})(\d{4}|\d{2})(?!\d)", "$1 $2 $3"))

    def canonical(s):
        quarter = F.regexp_replace(s, r"^(\d{4})[- ]?q([1-4])$", "$1-$2")
        out = F.when(s.contains("|"), F.lit(None).cast("string"))
        out = out.when(quarter != s, F.concat(F.substring(quarter, 1, 4), F.lit("-"), (F.substring(quarter, 6, 1).try_cast("int") * 3 - 2).cast("string"), F.lit("||||||")))
        for guard, rx, shape in _TIMES:
            out = out.when(s.rlike(guard), F.regexp_replace(s, rx, shape))
        return out.otherwise(F.concat(F.regexp_replace(s, r"(?<=\d)t$", ""), F.lit("||||||")))

    def moment(p):
        day = F.trim(F.regexp_replace(p[0], r"[\s.,;/'-]+", " "))
        zero = lambda c: F.when(c == "", F.lit("0")).otherwise(c)
        text = F.concat(let(F.split(day, " ", -1), lambda tokens: _date_text(tokens, year)), F.lit(" "), hour_of(p[1], p[5]).cast("string"),
                        F.lit(":"), zero(p[2]), F.lit(":"), zero(p[3]), F.lit("."), F.substring(F.rpad(p[4], 6, "0"), 1, 6))
        return F.when(F.size(p) == 7, text.try_cast("timestamp_ntz") - F.make_dt_interval(mins=zone_minutes(p[6])))

    digits = x.cast("string").rlike(r"\d")
    return F.when(digits, let(t, lambda s: let(canonical(s), lambda c: let(F.split(c, r"\|", -1), moment))))
