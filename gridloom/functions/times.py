"""Date-times (timestamps without zone, whole seconds) and durations (double seconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the units.
SECOND, MINUTE, HOUR, DAY = 1.0, 60.0, 3600.0, 86400.0
YEAR, MONTH = 365.25 * DAY, 30.44 * DAY


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def datetime(text) -> Column:
    """'YYYY-MM-DD' or 'YYYY-MM-DD HH:MM:SS'; anything else is null."""
    return F.try_to_timestamp(_c(text), F.lit("yyyy-MM-dd[ HH:mm:ss]")).cast("timestamp_ntz")


def _unit(size: float):
    return lambda x: _c(x).cast("double") * size


years, months, days, hours, minutes, seconds = map(_unit, (YEAR, MONTH, DAY, HOUR, MINUTE, SECOND))


def epoch(t: Column) -> Column:
    """Whole seconds since 1970, also before it."""
    return F.unix_seconds(t.cast("timestamp"))


def add(t: Column, duration) -> Column:
    return F.timestamp_seconds(epoch(t) + F.floor(_c(duration))).cast("timestamp_ntz")


def subtract(t: Column, duration) -> Column:
    return F.timestamp_seconds(epoch(t) - F.floor(_c(duration))).cast("timestamp_ntz")


def between(a: Column, b: Column) -> Column:
    """a - b in seconds."""
    return (epoch(a) - epoch(b)).cast("double")


def text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def duration_text(d: Column) -> Column:
    """Days and clock time of a duration."""
    whole = F.floor(d)
    return F.format_string("%dd %02d:%02d:%02d", F.floor(whole / 86400), F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60, whole % 60)
