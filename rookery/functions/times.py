"""Time arithmetic on UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor(seconds_between(later, earlier) / 86400)


def within_minutes(ts: Column, kick: Column, before: int, after: int) -> Column:
    """ts in [kick - before, kick + after], both ends included."""
    gap = F.unix_micros(ts) - F.unix_micros(kick)
    return (gap >= -before * 60_000_000) & (gap <= after * 60_000_000)


def local_date(ts: Column, zone: str = "America/Chicago") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_label(ts: Column, zone: str = "America/Chicago") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "EEE MMM d, h:mm a")


def to_utc(local: Column, zone: Column | str) -> Column:
    return F.to_utc_timestamp(local, zone)


def hours_since(ts: Column, now: Column) -> Column:
    return seconds_between(now, ts) / 3600


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
