"""Labels of times, durations and sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a time that is missing or can't be read, and how long a letter takes to speak.
NONE = "—"
LEAST_MS, MS_A_LETTER = 600, 55


def time_of(text: Column) -> Column:
    """A timestamp from its text; null where it can't be read."""
    return text.try_cast("timestamp")


def minute_label(time: Column, none: str = NONE) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm"), F.lit(none))


def input_label(time: Column) -> Column:
    """As a form's field wants it; empty for none."""
    return F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm"), F.lit(""))


def day_label(time: Column, none: str = NONE) -> Column:
    """Nov 3, 2026."""
    return F.coalesce(F.date_format(time, "MMM d, yyyy"), F.lit(none))


def call_clock(start: Column, end: Column) -> Column:
    """m:ss between two times, to the nearest second and never below 0; `ongoing` without an end, empty without a start."""
    ms = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    s = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5)).cast("long")
    return F.when(start.isNull(), "").when(end.isNull(), "ongoing").otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def list_label(time: Column, now: Column) -> Column:
    """The time for today, month and day for this year, else the year too; empty for none."""
    short = F.when(F.to_date(time) == F.to_date(now), F.date_format(time, "h:mm a")).when(F.year(time) == F.year(now), F.date_format(time, "MMM d")).otherwise(F.date_format(time, "MMM d, yyyy"))
    return F.coalesce(short, F.lit(""))


def relative_day(time: Column, now: Column) -> Column:
    """Today, Yesterday, or the day by name."""
    days = F.datediff(F.to_date(now), F.to_date(time))
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").otherwise(F.date_format(time, "MMMM d, yyyy"))


def megabytes(n: Column) -> Column:
    return F.format_string("%.1f MB", n / (1024 * 1024))


def speaking_ms(text: Column) -> Column:
    return F.greatest(F.lit(LEAST_MS), MS_A_LETTER * F.length(F.coalesce(text, F.lit(""))))
