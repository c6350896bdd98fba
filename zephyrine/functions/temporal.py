"""Dates, timestamps and intervals.

An interval is a struct ``{m int, d int, us long}``: months, days, microseconds, kept apart and compared
in that order. The session's zone must be UTC; zones are arguments.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyrine.session import ship

INTERVAL = "struct<m:int,d:int,us:long>"
DAY_US = 86_400_000_000
#: The origin of date_bin() by default, in microseconds since 1970: 2001-01-01.
ORIGIN = 978_307_200_000_000
#: The Julian day of 1970-01-01.
JULIAN = 2_440_588

#: Unit -> (months, days, microseconds)
UNITS = {
    "microsecond": (0, 0, 1),
    "millisecond": (0, 0, 1_000),
    "second": (0, 0, 1_000_000),
    "minute": (0, 0, 60_000_000),
    "hour": (0, 0, 3_600_000_000),
    "day": (0, 1, 0),
    "week": (0, 7, 0),
    "month": (1, 0, 0),
    "year": (12, 0, 0),
}
SHORT = {"us": "microsecond", "usec": "microsecond", "ms": "millisecond", "msec": "millisecond", "sec": "second", "min": "minute", "hr": "hour", "mon": "month"}


def parse_interval(text: str | None) -> tuple[int, int, int] | None:
    """``[sign]<n> <unit> …`` -> months, days, microseconds."""
    if text is None:
        return None
    out = [0, 0, 0]
    rest = re.sub(r"([+-])\s+(?=\d)", r"\1", text.strip())
    found = list(re.finditer(r"([+-]?\d+)\s*([A-Za-z]+)", rest))
    if not found or re.sub(r"([+-]?\d+)\s*([A-Za-z]+)", "", rest).strip():
        raise ValueError(f"not an interval: {text}")
    for m in found:
        name = m[2].lower()
        unit = SHORT.get(name) or (name if name in UNITS else SHORT.get(name.rstrip("s")) or name.rstrip("s"))
        if unit not in UNITS:
            raise ValueError(f"unknown unit: {m[2]}")
        for i, k in enumerate(UNITS[unit]):
            out[i] += int(m[1]) * k
    return tuple(out)


def make(m: Column | int = 0, d: Column | int = 0, us: Column | int = 0) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(m).cast("int").alias("m"), c(d).cast("int").alias("d"), c(us).cast("long").alias("us"))


def interval(text: str | Column) -> Column:
    """An interval from a literal or a string column."""
    if isinstance(text, str):
        return make(*parse_interval(text))

    ship()

    @F.pandas_udf(INTERVAL)
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_interval(x) or (None, None, None) for x in s], columns=["m", "d", "us"])

    return F.when(text.isNotNull(), parse(text))


def interval_add(a: Column, b: Column) -> Column:
    return make(a["m"] + b["m"], a["d"] + b["d"], a["us"] + b["us"])


def interval_neg(a: Column) -> Column:
    return make(-a["m"], -a["d"], -a["us"])


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def add_interval(ts: Column, iv: Column) -> Column:
    """Timestamp plus interval; days beyond a month's end run on into the next month."""
    ts = ts.cast("timestamp")
    first = F.trunc(ts.cast("date"), "month")
    day = F.date_add(F.add_months(first, iv["m"]), F.dayofmonth(ts) - 1 + iv["d"])
    clock = F.unix_micros(ts) - F.unix_micros(ts.cast("date").cast("timestamp"))
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + clock + iv["us"])


def ts_diff(a: Column, b: Column) -> Column:
    """Interval between timestamps, all in microseconds."""
    return F.when(a.isNotNull() & b.isNotNull(), make(0, 0, micros(a) - micros(b)))


def date_diff(a: Column, b: Column) -> Column:
    return F.datediff(a, b).cast("long")


def date_bin(iv: str, ts: Column, origin: int = ORIGIN) -> Column:
    """Start of the interval-sized bin that holds ``ts``, bins counted from ``origin`` (microseconds).

    The interval must be positive and without months; a timestamp before the origin raises.
    """
    m, d, us = parse_interval(iv)
    span = d * DAY_US + us
    if m or span <= 0:
        raise ValueError("date_bin: the interval must be positive and without months")
    at = micros(ts) - origin
    late = F.when(at < 0, F.raise_error(F.lit("date_bin: origin after timestamp")).cast("long")).otherwise(at)
    return F.timestamp_micros(late - late % span + origin)


def date_trunc(field: str, ts: Column, zone: str | None = None) -> Column:
    """Zero below ``field`` (year to microsecond), in a zone."""
    ts = ts.cast("timestamp")
    if field not in UNITS or field == "week":
        raise ValueError(f"date_trunc: unknown field {field}")
    if zone:
        return F.to_utc_timestamp(F.date_trunc(field, F.from_utc_timestamp(ts, zone)), zone)
    return F.date_trunc(field, ts)


def interval_trunc(field: str, iv: Column) -> Column:
    """Zero below ``field``. Years are twelve months; hours and less are the microseconds' part."""
    def cut(x: Column, unit: int) -> Column:
        return x - x % unit

    if field == "year":
        return make(cut(iv["m"], 12))
    if field == "month":
        return make(iv["m"])
    if field == "day":
        return make(iv["m"], iv["d"])
    return make(iv["m"], iv["d"], cut(iv["us"], UNITS[field][2]))


def extract(field: str, ts: Column, zone: str | None = None) -> Column:
    """An integer field; milli- and microseconds are those within the second."""
    ts = ts.cast("timestamp")
    ts = F.from_utc_timestamp(ts, zone) if zone else ts
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    if field in parts:
        return parts[field](ts).cast("long")
    within = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    if field == "millisecond":
        return F.floor(within / 1000).cast("long")
    if field == "microsecond":
        return within.cast("long")
    raise ValueError(f"extract: unknown field {field}")


def extract_interval(field: str, iv: Column) -> Column:
    """Years and months split the months; hours are all of the microseconds' part."""
    us = iv["us"]
    whole = lambda x, unit: ((x - x % unit) / unit).cast("long")
    return {
        "year": whole(iv["m"], 12),
        "month": (iv["m"] % 12).cast("long"),
        "day": iv["d"].cast("long"),
        "hour": whole(us, 3_600_000_000),
        "minute": whole(us % 3_600_000_000, 60_000_000),
        "second": whole(us % 60_000_000, 1_000_000),
        "millisecond": whole(us % 1_000_000, 1_000),
        "microsecond": (us % 1_000_000).cast("long"),
    }[field]


def at_timezone(ts: Column, zone: str) -> Column:
    """A timestamp as text in a zone."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def from_julian(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (day - JULIAN).cast("int"))


def to_julian(date: Column) -> Column:
    return (F.datediff(date, F.lit("1970-01-01").cast("date")) + JULIAN).cast("long")
