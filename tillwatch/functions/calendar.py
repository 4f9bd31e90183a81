"""Calendar expressions shared by the operators. Weekdays are ISO (1 = Monday) unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(ts: str | Column, width: str = "15 minutes") -> Column:
    """Start of the epoch-aligned bucket of ``width`` that holds ``ts``."""
    return F.window(_col(ts), width)["start"]


def iso_weekday(ts: str | Column) -> Column:
    return F.weekday(_col(ts)) + 1


def sunday_weekday(ts: str | Column) -> Column:
    """0 = Sunday, as SQL's DOW."""
    return F.dayofweek(_col(ts)) - 1


def epoch_seconds(ts: str | Column) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp")) / F.lit(1_000_000)


def is_weekend(ts: str | Column) -> Column:
    return F.weekday(_col(ts)) >= 5


def is_month_end(ts: str | Column) -> Column:
    return F.dayofmonth(_col(ts)) >= 28


def is_pay_window(ts: str | Column) -> Column:
    """Days 14-16 and the turn of the month (29 to 1)."""
    day = F.dayofmonth(_col(ts))
    return day.between(14, 16) | (day >= 29) | (day <= 1)


def is_dawn(ts: str | Column, last_hour: int = 6) -> Column:
    return F.hour(_col(ts)) <= last_hour


def is_night(ts: str | Column) -> Column:
    hour = F.hour(_col(ts))
    return (hour >= 22) | (hour <= 6)


# The four parts of the day, six hours each.
PARTS_OF_DAY = ["madrugada", "manana", "tarde", "noche"]


def part_of_day(ts: str | Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(p) for p in PARTS_OF_DAY]), (F.floor(F.hour(_col(ts)) / 6) + 1).cast("int")
    )
