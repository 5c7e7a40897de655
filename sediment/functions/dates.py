"""Weeks and lenient times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_monday(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def week_sunday(ts: Column) -> Column:
    day = F.to_date(ts)
    return F.date_sub(day, F.dayofweek(day) - 1)


def lenient_timestamp(c: Column) -> Column:
    """A time, or null if the text is none."""
    return F.try_to_timestamp(c)


def revived(c: Column) -> Column:
    """A date written as ISO 8601 or as milliseconds since 1970; null for anything else."""
    number = c.cast("string").rlike(r"^-?\d+(\.0+)?$")
    return F.when(number, F.timestamp_millis(F.when(number, c.cast("double")).cast("long"))).otherwise(F.try_to_timestamp(F.when(~number, c.cast("string"))))
