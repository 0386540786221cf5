"""Dates, local wall-clock time and time-to-event expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(x: Column, pattern: str = "M/d/yyyy") -> Column:
    return F.try_to_date(x, pattern)


def month_start(x: Column) -> Column:
    return F.trunc(x, "month")


def weekday_name(x: Column) -> Column:
    return F.date_format(x, "EEEE")


def season_of(day: Column, first_month: int = 9) -> Column:
    """Ending year of the season a day belongs to."""
    return F.year(day) + F.when(F.month(day) >= first_month, 1).otherwise(0)


def local_day(ts_utc: Column, zone: str = "America/Chicago") -> Column:
    """Calendar day in a time zone, across daylight saving."""
    return F.to_date(F.from_utc_timestamp(ts_utc, zone))


def local_time_utc(day: Column, hour: int, zone: str = "America/Chicago", plus_days: int = 0) -> Column:
    """UTC instant of a wall-clock hour on a local day."""
    naive = F.date_add(day, plus_days).cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS")
    return F.to_utc_timestamp(naive, zone)


def close_label(ts_utc: Column, zone: str = "America/Chicago") -> Column:
    return F.concat(F.lit("close@"), F.date_format(F.from_utc_timestamp(ts_utc, zone), "HHmm"))


def iso_timestamp(x: Column) -> Column:
    """ISO text to timestamp, null when it cannot be read."""
    return F.try_to_timestamp(x)


def minutes_between(start: Column, captured: Column) -> Column:
    """Minutes from the capture to the start of the event; null if either text is unreadable."""
    return (F.unix_micros(iso_timestamp(start)) - F.unix_micros(iso_timestamp(captured))) / 60e6


def event_from_expiry(expiry: Column, hours: int = 3) -> Column:
    return expiry - F.expr(f"INTERVAL {hours} HOURS")
