"""Time parsing, zones and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAUGE_TIME = "yyyy-MM-dd HH.mm.ss"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01 as a long; the usual chunk of a series."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def hour_number(ts: Column) -> Column:
    return F.floor(micros(ts) / F.lit(3_600_000_000)).cast("long")


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def month_of(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def parse_gauge_time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(GAUGE_TIME)).cast("timestamp_ntz")


def parse_day(c: Column) -> Column:
    """``dd/mm/yyyy``."""
    return F.try_to_timestamp(c, F.lit("dd/MM/yyyy")).cast("date")


def local_to_utc(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))


def utc_to_local(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def shift_hours(ts: Column, hours) -> Column:
    h = hours if isinstance(hours, Column) else F.lit(int(hours))
    return (ts + F.make_interval(hours=h)).cast("timestamp_ntz")


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3_600_000_000.0)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(60_000_000.0)


def midpoint(a: Column, b: Column) -> Column:
    half = ((micros(a) + micros(b)) / F.lit(2)).cast("long")
    return F.timestamp_micros(half).cast("timestamp_ntz")


def quarter_code(ts: Column) -> Column:
    """Year and last month of the quarter, e.g. 202603."""
    return F.format_string("%d%02d", F.year(ts), F.quarter(ts) * 3)


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def same_day_in_year(ts: Column, year: Column) -> Column:
    """Move a date to another year; 29 February becomes the 28th."""
    leap = (F.month(ts) == 2) & (F.dayofmonth(ts) == 29)
    return F.make_date(year, F.month(ts), F.when(leap, F.lit(28)).otherwise(F.dayofmonth(ts)))


def date_chunks(start: Column, end: Column, days: int) -> Column:
    """Array of (start, end) date pairs of at most ``days`` days, the last one clipped."""
    starts = F.sequence(start, end, F.expr(f"interval {int(days)} days"))
    return F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, days - 1), end).alias("end"))
    )
