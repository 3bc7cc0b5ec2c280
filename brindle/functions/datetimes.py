"""Date and time functions over TEXT, Julian days and unix seconds; TIMESTAMP_NTZ inside, text at the edge. Bad input is NULL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_JULIAN = 2440587.5
_LARGEST_JULIAN = 5373484.5


def _from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def from_number(n: Column, seconds: bool = False) -> Column:
    """0 <= n < 5373484.5 is a Julian day, else unix seconds; seconds=True always takes seconds (modifier unixepoch)."""
    n = n.cast("double")
    as_seconds = F.round(n * 1e6).try_cast("bigint")
    if seconds:
        return _from_micros(as_seconds)
    return _from_micros(F.when((n >= 0) & (n < _LARGEST_JULIAN), F.round((n - EPOCH_JULIAN) * 86400e3).try_cast("bigint") * 1000).otherwise(as_seconds))


def parse(x: Column, kind: str = "text", seconds: bool = False) -> Column:
    """A point in time. kind: text, number or timestamp."""
    if kind == "timestamp":
        return x.cast("timestamp_ntz")
    if kind == "number":
        return from_number(x, seconds)
    day = r"\d{4}-\d{2}-\d{2}"
    clock = r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
    t = F.btrim(x)
    return (
        F.when(F.lower(t) == "now", F.current_timestamp().cast("timestamp_ntz"))
        .when(t.rlike(rf"^{day}([ T]{clock})?Z?$"), F.regexp_replace(F.regexp_replace(t, "Z$", ""), "T", " ").try_cast("timestamp_ntz"))
        .when(t.rlike(rf"^{clock}$"), F.concat(F.lit("2000-01-01 "), t).try_cast("timestamp_ntz"))
        .when(t.rlike(r"^[+-]?\d+(\.\d*)?$"), from_number(t.try_cast("double"), seconds))
    )


def _plus_months(ts: Column, n: int) -> Column:
    """The month index moves and the day stays: 31 January + 1 month rolls into March."""
    index = F.year(ts) * 12 + F.month(ts) - 1 + n
    first = F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.timestamp_add("MICROSECOND", micros(ts) - micros(F.date_trunc("day", ts).cast("timestamp_ntz")), F.date_add(first, F.dayofmonth(ts) - 1).cast("timestamp_ntz"))


_SECONDS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}


def modify(ts: Column, modifier: str) -> Column:
    """One modifier, a literal."""
    m = modifier.strip().lower()
    if m in ("unixepoch", "julianday", "auto", "utc", "localtime", "subsec", "subsecond"):
        return ts
    if m.startswith("start of "):
        unit = m[9:].strip()
        return F.date_trunc(unit, ts).cast("timestamp_ntz") if unit in ("day", "month", "year") else ts
    if w := re.fullmatch(r"weekday\s+([0-6])", m):
        return F.timestamp_add("DAY", F.pmod(F.lit(int(w[1])) - (F.dayofweek(ts) - 1), F.lit(7)), ts)
    if c := re.fullmatch(r"([+-])(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?", m):
        seconds = (int(c[2]) * 3600 + int(c[3]) * 60 + float(c[4] or 0)) * (-1 if c[1] == "-" else 1)
        return F.timestamp_add("MICROSECOND", F.lit(round(seconds * 1e6)), ts)
    if n := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s+(second|minute|hour|day|month|year)s?", m):
        if n[2] in ("month", "year"):
            return _plus_months(ts, int(float(n[1])) * (12 if n[2] == "year" else 1))
        return F.timestamp_add("MICROSECOND", F.lit(round(float(n[1]) * _SECONDS[n[2]] * 1e6)), ts)
    return F.lit(None).cast("timestamp_ntz")


def moment(x: Column, *modifiers: str, kind: str = "text") -> Column:
    ts = parse(x, kind, seconds="unixepoch" in [m.strip().lower() for m in modifiers])
    for m in modifiers:
        ts = modify(ts, m)
    return ts


def date(x: Column, *modifiers: str, kind: str = "text") -> Column:
    return F.date_format(moment(x, *modifiers, kind=kind), "yyyy-MM-dd")


def time(x: Column, *modifiers: str, kind: str = "text") -> Column:
    return F.date_format(moment(x, *modifiers, kind=kind), "HH:mm:ss")


def datetime(x: Column, *modifiers: str, kind: str = "text") -> Column:
    return F.date_format(moment(x, *modifiers, kind=kind), "yyyy-MM-dd HH:mm:ss")


def julianday(x: Column, *modifiers: str, kind: str = "text") -> Column:
    return micros(moment(x, *modifiers, kind=kind)) / F.lit(86400e6) + EPOCH_JULIAN


def unixepoch(x: Column, *modifiers: str, kind: str = "text") -> Column:
    us = micros(moment(x, *modifiers, kind=kind))
    return us / F.lit(1e6) if "subsec" in modifiers else F.floor(us / F.lit(1e6)).cast("bigint")


def strftime(fmt: str, x: Column, *modifiers: str, kind: str = "text") -> Column:
    """A literal format, one expression for each specifier; unknown specifiers pass through."""
    ts = moment(x, *modifiers, kind=kind)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    of = {
        "d": lambda: two(F.dayofmonth(ts)), "m": lambda: two(F.month(ts)), "Y": lambda: F.lpad(F.year(ts).cast("string"), 4, "0"),
        "H": lambda: two(F.hour(ts)), "M": lambda: two(F.minute(ts)), "S": lambda: F.date_format(ts, "ss"), "f": lambda: F.date_format(ts, "ss.SSS"),
        "s": lambda: F.floor(micros(ts) / F.lit(1e6)).cast("string"), "J": lambda: julianday(ts, kind="timestamp").cast("string"),
        "j": lambda: F.lpad(F.dayofyear(ts).cast("string"), 3, "0"), "w": lambda: (F.dayofweek(ts) - 1).cast("string"), "u": lambda: (F.weekday(ts) + 1).cast("string"),
        "W": lambda: two(F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)), "%": lambda: F.lit("%"),
    }
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            out.append(of[fmt[i + 1]]() if fmt[i + 1] in of else F.lit(fmt[i : i + 2]))
            i += 2
        else:
            out.append(F.lit(fmt[i]))
            i += 1
    return F.when(ts.isNotNull(), F.concat(*out) if out else F.lit(""))


def current_date() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd")


def current_time() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def current_timestamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
