"""Cleaning of text-held values, durations and calendar parts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Up to three parts between dots; a fourth and later ones do not count.
_DAY_FIRST = r"(?s)\A([^.]*)\.([^.]*)(?:\.([^.]*))?(?:\..*)?\z"
_ONSET_DATE = r"(^|\D)\d{1,2}\.\d{1,2}\.(\d{4}|\d{2})(\D|$)"

# Every character that counts as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The spellings that count as true and false.
TRUE_WORDS = ["ja", "yes"]
FALSE_WORDS = ["nein", "no"]

# Weekday groups of the utilization tables, Monday first.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKDAY_GROUPS = ["Mon-Thu", "Fri", "Sat", "Sun"]

# German month names, January first.
MONTH_NAMES = [
    "Januar", "Februar", "März", "April", "Mai", "Juni",
    "Juli", "August", "September", "Oktober", "November", "Dezember",
]


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, line breaks included."""
    return F.trim(text, F.lit(WHITESPACE))


def fold(text: Column) -> Column:
    """Trimmed lower case, the form names are compared in."""
    return F.lower(strip(text))


def yes_no(text: Column) -> Column:
    """``ja``/``yes`` to true, ``nein``/``no`` to false, whatever the case or white space around; any other text to null."""
    word = fold(text)
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def to_number(text: Column) -> Column:
    """Text to double; whatever is not a plain decimal number becomes null."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def to_status_time(date_text: Column, time_text: Column) -> Column:
    """Separate date and time texts to one timestamp, null when either is blank or unreadable.

    Dates are ``yyyy-MM-dd`` or day-first ``dd.MM.yyyy``; seconds are optional.
    The texts are read in a lambda: written out for every status of a row, the generated method
    passes the size up to which the JVM compiles it, and parsing takes several times as long.
    """

    def parse(texts: Column) -> Column:
        iso = F.regexp_replace(F.trim(texts["day"]), _DAY_FIRST, "$3-$2-$1")
        time = strip(texts["time"])
        return F.when(time != "", F.concat(iso, F.lit(" "), time).try_cast("timestamp_ntz"))

    texts = F.struct(date_text.alias("day"), time_text.alias("time"))
    return F.transform(F.array(texts), parse)[0]


def micros_between(start: Column, end: Column) -> Column:
    """Exact whole microseconds from ``start`` to ``end``; null if either is null."""
    return ((end - start).cast("decimal(18,6)") * 1_000_000).cast("bigint")


def minutes(micros: Column) -> Column:
    return micros / F.lit(60_000_000.0)


def hours(micros: Column) -> Column:
    return micros / F.lit(3_600_000_000.0)


def hours_between(start: Column, end: Column) -> Column:
    return hours(micros_between(start, end))


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month").cast("timestamp_ntz")


def week_start(ts: Column) -> Column:
    """Midnight of the Monday of the week."""
    return F.trunc(F.to_date(ts), "week").cast("timestamp_ntz")


def month_label(ts: Column) -> Column:
    return F.date_format(F.to_date(ts), "yyyy-MM")


def _pick(names: list[str], position: Column) -> Column:
    """The ``position``-th of ``names``, counted from one."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), position)


def weekday_number(ts: Column) -> Column:
    """Monday is 0, Sunday is 6."""
    return F.weekday(F.to_date(ts))


def weekday_name(ts: Column) -> Column:
    return _pick(WEEKDAYS, weekday_number(ts) + 1)


def weekday_group(ts: Column) -> Column:
    return _pick([WEEKDAY_GROUPS[max(0, d - 3)] for d in range(7)], weekday_number(ts) + 1)


def month_name(month: Column) -> Column:
    return _pick(MONTH_NAMES, month)


def onset_kind(value: Column) -> Column:
    """``date`` for day, month and a two- or four-digit year, else ``time`` for text with a colon, else ``other``; blank: null."""
    return (
        F.when(value.rlike(_ONSET_DATE), "date")
        .when(value.contains(":"), "time")
        .when(strip(value) != "", "other")
    )


def within_days(ts: Column, first_day, last_day) -> Column:
    """Whole days ``first_day`` to ``last_day``, the last one included."""
    start = F.lit(str(first_day)).cast("date")
    stop = F.date_add(F.lit(str(last_day)).cast("date"), 1)
    return (ts >= start.cast("timestamp_ntz")) & (ts < stop.cast("timestamp_ntz"))


def within_years(ts: Column, first_year: int, last_year: int) -> Column:
    """1 January of ``first_year`` to 31 December of ``last_year``, both days whole."""
    return within_days(ts, f"{first_year:04d}-01-01", f"{last_year:04d}-12-31")


def relabel(value: Column, labels: Mapping[str, str], missing: str) -> Column:
    """Display label of a code: the mapped text, the code itself if unmapped, ``missing`` for null."""
    shown = F.when(value.isNull(), missing)
    for code, text in labels.items():
        shown = shown.when(value == code, text)
    return shown.otherwise(value)


def yes_no_label(flag: Column) -> Column:
    return F.when(flag, "Ja").when(~flag, "Nein")
