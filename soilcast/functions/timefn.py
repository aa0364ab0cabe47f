"""Time helpers that keep TIMESTAMP_NTZ and compute exact hour differences."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def hours_between(start: Column, end: Column) -> Column:
    """(end - start) in hours, from the exact microsecond difference."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def add_hours(ts: Column, hours: Column | int) -> Column:
    """ts + whole hours; keeps TIMESTAMP_NTZ."""
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return F.timestamp_add("HOUR", h, ts)


def hour_bucket(ts: Column) -> Column:
    """Truncate a TIMESTAMP_NTZ to the hour from its calendar fields (independent of the session time zone,
    unlike date_trunc, which goes through TIMESTAMP)."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the ISO week of a TIMESTAMP_NTZ (zone-independent)."""
    return F.date_sub(F.to_date(ts), F.weekday(ts)).cast("timestamp_ntz")


def weekday(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def season(ts: Column) -> Column:
    """(month % 12) div 3: 0 winter, 1 spring, 2 summer, 3 autumn."""
    return F.floor((F.month(ts) % 12) / 3).cast("int")


EPOCH = "1970-01-01 00:00:00"


def utc_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ from its calendar fields, whatever the session time zone."""
    seconds = F.unix_date(F.to_date(ts)) * F.lit(86_400).cast("long") + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * F.lit(1_000_000).cast("long") + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


# Year-month-day, basic or extended; optional time with 1 to 3 parts and a fraction; optional offset after a time.
ISO = (r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})"
       r"(?:[T ]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?)?"
       r"(Z|z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?$")


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP_NTZ in UTC: dates, times to the hour, minute, second or fraction (cut to
    microseconds), basic or extended form, 'T' or a space between. A 'Z' or +hh[[:]mm] suffix is applied as an offset;
    text without one is UTC wall time. Anything else gives null. No step goes through the session time zone."""
    t = F.trim(text)
    # matched once per text: the pattern's groups as an array, bound to `g` by a transform over one element
    groups = F.when(F.rlike(t, F.lit(ISO)), F.split(F.regexp_replace(t, ISO, ",".join(f"${i}" for i in range(1, 9))), ","))
    return F.get(F.transform(F.array(groups), _iso_time), F.lit(0))


def _iso_time(g: Column) -> Column:
    def part(i: int, default: str = "0") -> Column:
        x = F.get(g, F.lit(i - 1))
        return F.when(x == "", F.lit(default)).otherwise(x)

    second = F.concat(part(6), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0")).cast("decimal(8,6)")
    wall = F.try_make_timestamp_ntz(*[part(i).cast("int") for i in (1, 2, 3, 4, 5)], second)
    zone = F.get(g, F.lit(7))
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    sign = F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    minutes = F.when(zone.isin("", "Z", "z"), F.lit(0)).otherwise(
        sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    return wall - F.make_dt_interval(mins=minutes)
