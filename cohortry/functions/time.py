"""Time expressions: calendar days, elapsed days and years are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import DAYS_PER_YEAR


def calendar_date(col: Column) -> Column:
    """Cut the time of day off a timestamp."""
    return F.to_date(col)


def calendar_date_of_text(col: Column) -> Column:
    """Date of a `YYYY-MM-DD[ time]` string; malformed text raises in ANSI mode."""
    return F.to_date(F.substring_index(col, " ", 1))


def calendar_days(start: Column, end: Column) -> Column:
    """Midnights between two times: 23:00 to 01:00 next day is 1."""
    return F.datediff(F.to_date(end), F.to_date(start))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole elapsed days, rounded down: 23:00 to 01:00 is 0, twelve hours back is -1.

    Works on the interval between the two wall-clock times, so neither the session time
    zone nor floating point matters.
    """
    gap = end - start
    whole = F.extract(F.lit("DAY"), gap)
    return (whole - F.when(gap < F.make_dt_interval(whole), 1).otherwise(0)).cast("int")


def years(days: Column) -> Column:
    """Days as mean Gregorian years."""
    return days / F.lit(DAYS_PER_YEAR)
