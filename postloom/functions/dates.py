"""Days, platform time stamps and zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "America/Los_Angeles"


def platform_time(text: Column) -> Column:
    """``Wed May 27 10:00:00 +0000 2020``; the weekday is skipped, bad text is NULL."""
    return F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def local_to_utc(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall-clock time of ``zone`` as UTC wall-clock time.

    A repeated hour is read as daylight time. A missing hour is moved forward by Spark;
    it is set back here to the last instant before the gap, at microsecond precision.
    """
    utc = F.to_utc_timestamp(ts, zone)
    there_and_back = F.from_utc_timestamp(utc, zone)
    gap_start = F.date_trunc("hour", utc)
    return F.when(
        there_and_back != ts, gap_start - F.expr("interval 1 microsecond")
    ).otherwise(utc)


def day_text(day: Column, underscores: bool = False) -> Column:
    return F.date_format(day, "yyyy_MM_dd" if underscores else "yyyy-MM-dd")


def day_of_text(text: Column) -> Column:
    """Day from either spelling."""
    return F.try_to_date(F.replace(text, F.lit("_"), F.lit("-")), "yyyy-MM-dd")


def day_of_path(path: Column) -> Column:
    """First day written anywhere in a path or file name."""
    found = F.regexp_extract(path, r"([0-9]{4}[-_][0-9]{2}[-_][0-9]{2})", 1)
    return day_of_text(F.nullif(found, F.lit("")))


def days_between(first: Column, last: Column) -> Column:
    """All days from ``first`` to ``last``, both included, one row each."""
    return F.explode(F.sequence(first, last, F.expr("interval 1 day")))


def on_day(ts: Column, day: str) -> Column:
    """Half-open range, so the test reaches the file scan."""
    start = F.to_timestamp_ntz(F.lit(day))
    return (ts >= start) & (ts < start + F.expr("interval 1 day"))
