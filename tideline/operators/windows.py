"""Event windows: profile, expansion into days, flags on a series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Period = tuple[date, date]


def window_profile(
    calendar: DataFrame, kind: str = "kind", start: str = "start_day", end: str = "end_day"
) -> DataFrame:
    """Windows, first and last day per kind."""
    return calendar.groupBy(kind).agg(
        F.count(F.lit(1)).alias("windows"),
        F.min(start).alias("first_day"),
        F.max(end).alias("last_day"),
    )


def merge_windows(
    calendar: DataFrame,
    by: Sequence[str] = (),
    start: str = "start_day",
    end: str = "end_day",
) -> DataFrame:
    """Join overlapping or touching windows into disjoint ones.

    Windows with the same start are folded first, on the map side. What is left
    to put in order is at most one row per calendar day and group, whatever the
    number of windows.
    """
    reversed_window = F.raise_error(
        F.concat(F.lit("window ends before it starts: "), F.col(start), F.lit(" > "), F.col(end))
    ).cast("date")
    last = F.when(F.col(end) < F.col(start), reversed_window).otherwise(F.col(end))
    longest = calendar.groupBy(*by, start).agg(F.max(last).alias(end))
    in_order = Window.partitionBy(*by).orderBy(start)
    covered = F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = covered.isNull() | (F.col(start) > F.date_add(covered, 1))
    numbered = longest.withColumn("_opens", opens).withColumn(
        "_island",
        F.sum(F.col("_opens").cast("int")).over(
            in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    return (
        numbered.groupBy(*by, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def expand_windows(
    calendar: DataFrame,
    kind: str | None = None,
    within: Period | None = None,
    start: str = "start_day",
    end: str = "end_day",
    kind_column: str = "kind",
    day: str = "day",
) -> DataFrame:
    """Every day inside a window, once.

    Windows are merged before they are unrolled, so overlaps never multiply rows
    and no distinct is needed. ``within`` clips the result to a period.
    """
    chosen = calendar if kind is None else calendar.filter(F.col(kind_column) == kind)
    if within is not None:
        low, high = map(F.lit, within)
        chosen = chosen.filter((F.col(end) >= low) & (F.col(start) <= high))
    merged = merge_windows(chosen, start=start, end=end)
    if within is not None:
        merged = merged.select(
            F.greatest(start, low).alias(start), F.least(end, high).alias(end)
        )
    return merged.select(
        F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).alias(day)
    )


def _flag(df: DataFrame, unique_days: DataFrame, name: str, day: str) -> DataFrame:
    # Unique days are few; how they are joined is left to the sizes Spark measures.
    listed = unique_days.select(F.col(day).alias("_listed"))
    joined = df.join(listed, F.col(day) == F.col("_listed"), "left")
    return joined.select(*df.columns, F.col("_listed").isNotNull().alias(name))


def flag_days(
    df: DataFrame,
    days: DataFrame,
    name: str,
    day: str = "day",
) -> DataFrame:
    """Add a boolean: is the row's day among ``days``?  A day listed twice counts once."""
    return _flag(df, days.select(day).distinct(), name, day)


def flag_windows(
    df: DataFrame,
    calendar: DataFrame,
    kind: str | None = None,
    name: str = "in_window",
    day: str = "day",
    **columns: str,
) -> DataFrame:
    """Mark the days of a series that lie inside a window of the given kind."""
    return _flag(df, expand_windows(calendar, kind, day=day, **columns), name, day)
