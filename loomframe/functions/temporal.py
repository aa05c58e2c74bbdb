"""Dates, times and durations. Durations are day-time intervals; strftime patterns are translated."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .base import c, public, v

# Strftime fields and their pattern letters.
_FIELDS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "3f": "SSS", "6f": "SSSSSS",
    "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "Z": "z", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm",
}
_MICROS = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000,
}


def java_pattern(format: str) -> str:
    """A strftime pattern in Spark's letters."""
    out = []
    for field, text in re.findall(r"%(\.?[36]?[A-Za-z%])|([^%]+)", format):
        if field == "%":
            out.append("%")
        elif field:
            key = field.lstrip(".")
            if key not in _FIELDS:
                raise ValueError(f"no such field: %{field}")
            out.append(("." if field.startswith(".") else "") + _FIELDS[key])
        else:
            out.append("'" + text.replace("'", "''") + "'" if re.search(r"[A-Za-z']", text) else text)
    return "".join(out)


_FIELD_OF = {
    "date": F.to_date, "day": F.dayofmonth, "day_of_month": F.dayofmonth, "dayofmonth": F.dayofmonth, "hour": F.hour, "minute": F.minute, "month": F.month,
    "quarter": F.quarter, "year": F.year, "day_of_week": F.weekday, "day_of_year": F.dayofyear, "dayofyear": F.dayofyear, "week_of_year": F.weekofyear,
    "weekofyear": F.weekofyear, "second": F.second, "unix_date": lambda x: F.unix_date(F.to_date(x)), "last_day": F.last_day, "timestamp_seconds": F.timestamp_seconds,
    "timestamp_millis": F.timestamp_millis, "timestamp_micros": F.timestamp_micros, "date_from_unix_date": F.date_from_unix_date,
    "time": lambda x: _timed(x),
}


def _timed(x: Column) -> Column:
    """The type is off by default in this Spark; the session that plans the query must allow it."""
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.timeType.enabled", "true")
    return F.make_time(F.hour(x), F.minute(x), F.date_part(F.lit("second"), x))


def _one(name, f):
    def function(expr) -> Column:
        return f(c(expr))

    function.__name__ = function.__qualname__ = name
    function.__doc__ = f"{name} of a date or timestamp (weekdays count from Monday, 0)." if name == "day_of_week" else f"{name} of the value."
    return public(function)


for _name, _f in _FIELD_OF.items():
    globals()[_name] = _one(_name, _f)


def _micros(x: Column) -> Column:
    """Microseconds since 1970 of the wall clock, for timestamps with and without zone."""
    return F.unix_micros(x.cast("timestamp"))


@public
def microsecond(expr):
    return F.pmod(_micros(c(expr)), F.lit(1_000_000)).cast("int")


@public
def millisecond(expr):
    return F.floor(F.pmod(_micros(c(expr)), F.lit(1_000_000)) / 1000).cast("int")


@public
def nanosecond(expr):
    return (F.pmod(_micros(c(expr)), F.lit(1_000_000)) * 1000).cast("int")


@public
def strftime(expr, format: str = "%Y-%m-%dT%H:%M:%S%.f"):
    return F.date_format(c(expr), java_pattern(format))


@public
def date_format(expr, format: str = "%Y-%m-%dT%H:%M:%S%.f"):
    return strftime(expr, format)


@public
def to_date(expr, format: str):
    return F.to_date(c(expr), java_pattern(format))


@public
def to_datetime(expr, format: str, timezone: str | None = None):
    out = F.to_timestamp_ntz(c(expr), F.lit(java_pattern(format)))
    return out if timezone is None else F.to_utc_timestamp(out.cast("timestamp"), timezone)


def _total(name: str, micros: float):
    def function(expr) -> Column:
        us = F.extract(F.lit("day"), c(expr)).cast("long") * 86_400_000_000 + F.extract(F.lit("hour"), c(expr)).cast("long") * 3_600_000_000
        us = us + F.extract(F.lit("minute"), c(expr)).cast("long") * 60_000_000 + (F.extract(F.lit("second"), c(expr)) * 1_000_000).cast("long")
        return us * 1000 if micros < 1 else (us / micros).cast("long")

    function.__name__ = function.__qualname__ = name
    function.__doc__ = f"{name} of a duration, cut towards zero."
    return public(function)


for _name, _n in (("nanoseconds", 0.001), ("microseconds", 1), ("milliseconds", 1e3), ("seconds", 1e6), ("minutes", 6e7), ("hours", 3.6e9), ("days", 8.64e10)):
    globals()[f"total_{_name}"] = _total(f"total_{_name}", _n)


@public
def convert_time_zone(expr, to_timezone: str, from_timezone: str | None = None):
    """The same instant on another wall clock."""
    return F.convert_timezone(F.lit(from_timezone or "UTC"), F.lit(to_timezone), c(expr).cast("timestamp_ntz"))


@public
def convert_timezone(target_timezone: str, source_timestamp):
    return convert_time_zone(source_timestamp, target_timezone)


@public
def replace_time_zone(expr, timezone: str | None = None):
    """The same wall clock in another zone."""
    x = c(expr).cast("timestamp_ntz")
    return x if timezone is None else F.to_utc_timestamp(x.cast("timestamp"), timezone)


@public
def from_utc_timestamp(expr, timezone: str):
    return F.from_utc_timestamp(c(expr), timezone)


@public
def to_utc_timestamp(expr, timezone: str):
    return F.to_utc_timestamp(c(expr), timezone)


@public
def date_trunc(interval: str, expr, relative_to=None):
    """The beginning of the bucket of 'N unit' (week to microsecond) that holds the time, counted from 1970 or relative_to."""
    n, _, unit = interval.strip().rpartition(" ")
    unit = unit.rstrip("s")
    if unit not in _MICROS:
        raise ValueError(f"no such unit: {unit}")
    size = int(n or 1) * _MICROS[unit]
    origin = F.lit(0) if relative_to is None else _micros(v(relative_to))
    at = _micros(c(expr))
    return F.timestamp_micros(at - F.pmod(at - origin, F.lit(size))).cast("timestamp_ntz")


@public
def trunc(expr, interval: str, relative_to=None):
    return date_trunc(interval, expr, relative_to)


@public
def to_unix_epoch(expr, time_unit: str = "s"):
    us, per = _micros(c(expr)), {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": 0.001}[time_unit]
    return us * 1000 if per < 1 else F.floor(us / per).cast("long")


@public
def current_date():
    return F.current_date()


@public
def current_timestamp():
    return F.current_timestamp()


@public
def current_timezone():
    return F.lit("UTC")


@public
def date_add(expr, days):
    return F.date_add(c(expr), v(days))


@public
def dateadd(expr, days):
    return F.date_add(c(expr), v(days))


@public
def date_sub(expr, days):
    return F.date_sub(c(expr), v(days))


@public
def date_diff(end, start):
    return F.datediff(c(end), c(start))


@public
def datediff(end, start):
    return F.datediff(c(end), c(start))


@public
def datepart(part: str, expr):
    return F.date_part(F.lit(part), c(expr))


@public
def add_months(expr, months):
    return F.add_months(c(expr), v(months))


@public
def months_between(end, start):
    return F.months_between(c(end), c(start))


@public
def next_day(expr, day_of_week: str):
    return F.next_day(c(expr), day_of_week)


@public
def from_unixtime(expr, format: str = "%Y-%m-%d %H:%M:%S"):
    return F.from_unixtime(c(expr), java_pattern(format))


@public
def make_date(year, month, day):
    """Null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", c(year), c(month), c(day)), "yyyy-MM-dd")


@public
def make_timestamp(year, month, day, hour, minute, second, timezone=None):
    parts = [c(x) for x in (year, month, day, hour, minute, second)]
    return F.try_make_timestamp(*parts, *([] if timezone is None else [v(timezone)]))


@public
def make_timestamp_ltz(year, month, day, hour, minute, second, timezone=None):
    parts = [c(x) for x in (year, month, day, hour, minute, second)]
    return F.try_make_timestamp_ltz(*parts, *([] if timezone is None else [v(timezone)]))
