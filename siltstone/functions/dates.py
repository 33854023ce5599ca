"""Dates and times with the reference's semantics.

Invalid texts and zero dates give null. Times of day that may be negative or exceed 24 hours are
day-time intervals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day number of 1970-01-01 in TO_DAYS.
EPOCH_DAYS = 719528

#: Specifiers of DATE_FORMAT and STR_TO_DATE and the patterns of the same content.
SPECIFIERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "M": "MMMM", "b": "MMM", "d": "dd", "e": "d", "j": "DDD", "H": "HH", "k": "H",
    "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "W": "EEEE", "a": "EEE", "T": "HH:mm:ss", "r": "hh:mm:ss a",
}


def pattern(spec: str) -> str:
    """A DATE_FORMAT string as Spark's pattern; other letters are quoted."""
    out = ""
    for known, other in re.findall(r"%(.)|([^%]+)", spec):
        if other:
            quoted = other.replace("'", "''")
            out += f"'{quoted}'" if any(ch.isalpha() for ch in other) else quoted
        else:
            out += SPECIFIERS.get(known, f"'{known}'" if known.isalpha() else known)
    return out


def date_format(d: Column, spec: str) -> Column:
    return F.date_format(d, pattern(spec))


def str_to_date(s: Column, spec: str) -> Column:
    """STR_TO_DATE; null where the text doesn't fit."""
    return F.try_to_timestamp(s, F.lit(pattern(spec)))


def safe_date(s: Column) -> Column:
    """A date; null for invalid ones such as 1997-11-31 and for zero dates."""
    return s.try_cast("date")


def date_diff(a: Column, b: Column) -> Column:
    """DATEDIFF in days of two texts or dates; null if either is invalid."""
    return F.datediff(safe_date(a), safe_date(b))


def date_add(d: Column, n: Column | int, unit: str) -> Column:
    """DATE_ADD(d, INTERVAL n unit) of a timestamp; months and years stop at the month's end."""
    n = F.lit(n) if isinstance(n, int) else n
    if unit in ("YEAR", "QUARTER", "MONTH"):
        return d + F.make_ym_interval(F.lit(0), (n * {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit]).cast("int"))
    seconds = {"WEEK": 604800, "DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    if unit == "MICROSECOND":
        return d + F.make_dt_interval(secs=(n / F.lit(1_000_000)).cast("decimal(18,6)"))
    return d + F.make_dt_interval(secs=(n * seconds[unit]).cast("decimal(18,6)"))


def date_sub(d: Column, n: Column | int, unit: str) -> Column:
    return date_add(d, -n, unit)


def time_diff(a: Column, b: Column) -> Column:
    """TIMEDIFF: an interval."""
    return a - b


def interval_seconds(i: Column) -> Column:
    """Seconds of a day-time interval, as a double: TIME_TO_SEC."""
    part = lambda u: F.extract(F.lit(u), i).cast("double")
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def sec_to_time(n: Column) -> Column:
    """SEC_TO_TIME: an interval."""
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def time_text(i: Column) -> Column:
    """[-]HH:MM:SS of an interval, hours beyond 24 as they are."""
    total = F.abs(interval_seconds(i)).cast("bigint")
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    parts = [F.floor(total / 3600), F.floor(total / 60) % 60, total % 60]
    return F.concat(F.when(interval_seconds(i) < 0, "-").otherwise(""), F.concat_ws(":", *(two(p.cast("bigint")) for p in parts)))


def make_time(h: Column, m: Column, s: Column) -> Column:
    """MAKETIME: the sign of the hours holds for all parts; null for minutes or seconds outside 0 to 59."""
    sign = F.when(h < 0, -1).otherwise(1)
    secs = h.cast("bigint") * 3600 + sign * (m * 60 + s)
    return F.when(m.between(0, 59) & s.between(0, 59), sec_to_time(secs))


def make_date(year: Column, day: Column) -> Column:
    """MAKEDATE: the day-th day of a year, perhaps beyond it; null below 1."""
    return F.when(day >= 1, F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (day - 1).cast("int")))


def add_time(d: Column, h: int = 0, m: int = 0, s: float = 0) -> Column:
    """ADDTIME with a constant time; negative parts for SUBTIME."""
    return d + F.make_dt_interval(secs=F.lit(h * 3600 + m * 60 + s).cast("decimal(18,6)"))


def to_days(d: Column) -> Column:
    return F.unix_date(d.cast("date")) + EPOCH_DAYS


def from_days(n: Column) -> Column:
    return F.date_from_unix_date((n - EPOCH_DAYS).cast("int"))


def microsecond(t: Column) -> Column:
    return (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint") % 1_000_000


#: Units of EXTRACT that join several parts; parts from the greatest, microseconds as 'f'.
COMPOUND = {
    "YEAR_MONTH": "Ym", "DAY_HOUR": "dH", "DAY_MINUTE": "dHi", "DAY_SECOND": "dHis", "DAY_MICROSECOND": "dHisf", "HOUR_MINUTE": "Hi",
    "HOUR_SECOND": "His", "HOUR_MICROSECOND": "Hisf", "MINUTE_SECOND": "is", "MINUTE_MICROSECOND": "isf", "SECOND_MICROSECOND": "sf",
}


def extract(unit: str, t: Column) -> Column:
    """EXTRACT(unit FROM t), also of the compound units, whose parts follow each other in two digits, microseconds in six."""
    parts = {"Y": F.year, "m": F.month, "d": F.dayofmonth, "H": F.hour, "i": F.minute, "s": F.second, "f": microsecond}
    simple = {"YEAR": "Y", "MONTH": "m", "DAY": "d", "HOUR": "H", "MINUTE": "i", "SECOND": "s", "MICROSECOND": "f"}
    if unit == "QUARTER":
        return F.quarter(t).cast("bigint")
    if unit == "WEEK":
        return week(t, 0).cast("bigint")
    codes = COMPOUND.get(unit) or simple[unit]
    out = parts[codes[0]](t).cast("bigint")
    for c in codes[1:]:
        out = out * (1_000_000 if c == "f" else 100) + parts[c](t).cast("bigint")
    return out


def week(t: Column, mode: int = 0) -> Column:
    """WEEK(t, mode) for the eight modes.

    Weeks begin on Monday in odd modes, else on Sunday; in modes 0, 1, 4, 5 days before the first week
    are of week 0, in the others of the last week of the year before. The first week is the first
    with four days of the year in modes 1, 3, 4, 6, else the first whole one.
    """
    d = t.cast("date")
    monday = mode % 2 == 1
    four = mode in (1, 3, 4, 6)
    zero = mode in (0, 1, 4, 5)
    weekday = F.weekday(d) if monday else F.dayofweek(d) - 1  # 0 is the week's first day

    def first(year: Column) -> Column:
        """Day on which week 1 of the year begins."""
        new_year = F.make_date(year, F.lit(1), F.lit(1))
        at = F.weekday(new_year) if monday else F.dayofweek(new_year) - 1
        shift = F.when(at <= 3, -at).otherwise(7 - at) if four else (7 - at) % 7
        return F.date_add(new_year, shift.cast("int"))

    year = F.year(d)
    here = F.floor(F.datediff(d, first(year)) / 7) + 1
    if zero:
        return F.when(d < first(year), 0).otherwise(here).cast("int")
    start = F.date_sub(d, weekday.cast("int"))
    last = F.floor(F.datediff(d, first(year - 1)) / 7) + 1
    return F.when(d < first(year), last).when(start >= first(year + 1), F.floor(F.datediff(d, first(year + 1)) / 7) + 1).otherwise(here).cast("int")


def period_add(p: Column, n: Column) -> Column:
    """PERIOD_ADD of YYYYMM."""
    months = F.floor(p / 100) * 12 + p % 100 - 1 + n
    return (F.floor(months / 12) * 100 + months % 12 + 1).cast("bigint")


def convert_tz(t: Column, source: str, target: str) -> Column:
    """CONVERT_TZ of a timestamp without zone."""
    return F.convert_timezone(F.lit(source), F.lit(target), t)
