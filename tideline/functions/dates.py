"""Date expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, Monday first.
WEEKDAYS_EN = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
WEEKDAYS_PT = ("segunda", "terca", "quarta", "quinta", "sexta", "sabado", "domingo")


def iso_weekday(day: Column | str) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(day) + F.lit(1)


def weekday_label(weekday: Column | str, labels: Sequence[str] = WEEKDAYS_EN) -> Column:
    if len(labels) != 7:
        raise ValueError("weekday labels must be seven names, Monday first")
    number = F.col(weekday) if isinstance(weekday, str) else weekday
    return F.element_at(F.array(*[F.lit(name) for name in labels]), number)


def is_weekend(weekday: Column | str) -> Column:
    return (F.col(weekday) if isinstance(weekday, str) else weekday) >= 6


def week_start(day: Column | str) -> Column:
    """Monday of the week, as a timestamp."""
    return F.date_trunc("week", day)


def span_days(first: Column | str, last: Column | str) -> Column:
    """Calendar days from first to last, both counted."""
    return F.datediff(last, first) + F.lit(1)


def days_to_month_end(day: Column | str) -> Column:
    return F.datediff(F.last_day(day), day)


def month_slot(day: Column | str) -> Column:
    """Which occurrence of its weekday a day is within its month (1 to 5)."""
    return (F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("int")
