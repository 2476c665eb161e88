"""Checks that run before anything is written.

A check is a report (a DataFrame of one row) and a decision on that row. Each
report is one pass over its input; only the single row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tideline.functions.dates import span_days
from tideline.functions.numbers import count_where


class GateError(ValueError):
    """A batch failed its checks; nothing has been written."""


def any_null(columns: Sequence[str]) -> Column:
    return reduce(or_, (F.col(c).isNull() for c in columns))


def null_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows, rows that lack any required value, and missing values per column."""
    each = [count_where(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        count_where(any_null(required)).alias("null_rows"),
        *each,
    )


def duplicate_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys (NULL is a key like any other) and the surplus."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        count_where(F.col("_n") > 1).alias("repeated_keys"),
    ).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_keys"))


def key_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """What an upsert must know of its batch: rows, repeated keys, missing key parts."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0)
    return per_key.agg(
        F.coalesce(F.sum("_n"), zero).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), zero).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(any_null(key), F.col("_n"))), zero).alias("null_rows"),
    )


def gap_report(
    df: DataFrame, day: str = "day", keys: Sequence[str] = (), folded: bool = False
) -> DataFrame:
    """Is every series contiguous?  Totals over all series, one row.

    Distinct days are compared with the span, so a repeated day cannot hide a gap.
    ``folded`` says that rows are one per (keys, day) already, as ``daily_series`` gives
    them. Folding those again changes nothing, but a task would hold all its (keys, day)
    groups three times: as the roll-up leaves them and on both sides of the second fold.
    """
    if folded:
        per_day, rows = df, F.count(F.lit(1))
    else:
        per_day = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"))
        rows = F.sum("_n")
    per_series = per_day.groupBy(*keys).agg(
        rows.alias("_n"),
        F.count(day).alias("_days"),
        F.min(day).alias("_first"),
        F.max(day).alias("_last"),
    )
    expected = F.coalesce(span_days("_first", "_last"), F.lit(0)).cast("bigint")
    sized = per_series.withColumn("_expected", expected)
    return sized.agg(
        F.count(F.lit(1)).alias("series"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_expected"), F.lit(0)).alias("days_in_span"),
        count_where(F.col("_days") != F.col("_expected")).alias("series_with_gaps"),
    ).withColumn("contiguous", F.col("series_with_gaps") == 0)


def interval_report(df: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals whose start lies after their end."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        count_where(F.col(start) > F.col(end)).alias("inverted"),
    )


def vocabulary_report(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is outside the vocabulary (NULL is left to the null check)."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        count_where(~F.col(column).isin(*allowed)).alias("unknown_values"),
    )


def size_report(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Row count, whether the batch is empty, and whether it hit a page cap."""
    report = df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "non_empty", F.col("rows") > 0
    )
    if cap is None:
        return report
    return report.withColumn("maybe_truncated", F.col("rows") >= cap)


def table_profile(df: DataFrame, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """Rows, first and last day, repeated (keys, day) rows.

    A missing day is not a distinct value here, as in ``COUNT(DISTINCT)``.
    """
    per_day = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"))
    return per_day.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.count(day).alias("_distinct"),
    ).select(
        "rows", "first_day", "last_day", (F.col("rows") - F.col("_distinct")).alias("duplicates")
    )


def series_report(
    df: DataFrame,
    day: str = "day",
    keys: Sequence[str] = (),
    required: Sequence[str] = (),
) -> DataFrame:
    """Everything the load of a daily series must know, in one pass.

    The first aggregate folds rows to one per (keys, day), the second to one per
    series, the third to one row.
    """
    required = list(required) or [day]
    per_day = df.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("_n"), count_where(any_null(required)).alias("_nulls")
    )
    per_series = per_day.groupBy(*keys).agg(
        F.sum("_n").alias("_n"),
        F.count(F.lit(1)).alias("_distinct"),
        F.count(day).alias("_days"),
        F.sum("_nulls").alias("_nulls"),
        F.min(day).alias("_first"),
        F.max(day).alias("_last"),
    )
    expected = F.coalesce(span_days("_first", "_last"), F.lit(0)).cast("bigint")
    zero = F.lit(0)
    return per_series.agg(
        F.coalesce(F.sum("_n"), zero).alias("rows"),
        F.coalesce(F.sum("_nulls"), zero).alias("null_rows"),
        F.coalesce(F.sum(F.col("_n") - F.col("_distinct")), zero).alias("duplicate_rows"),
        count_where(F.col("_days") != expected).alias("series_with_gaps"),
        F.min("_first").alias("first_day"),
        F.max("_last").alias("last_day"),
    )


def calendar_report(
    calendar: DataFrame,
    vocabulary: Sequence[str],
    required: Sequence[str],
    kind: str = "kind",
    start: str = "start_day",
    end: str = "end_day",
) -> DataFrame:
    """All checks of a window calendar, in one pass over it."""
    per_key = calendar.groupBy(start, kind).agg(
        F.count(F.lit(1)).alias("_n"),
        count_where(any_null(required)).alias("_nulls"),
        count_where(F.col(start) > F.col(end)).alias("_inverted"),
        count_where(~F.col(kind).isin(*vocabulary)).alias("_unknown"),
    )
    zero = F.lit(0)
    return per_key.agg(
        F.coalesce(F.sum("_n"), zero).alias("rows"),
        F.coalesce(F.sum("_nulls"), zero).alias("null_rows"),
        F.coalesce(F.sum("_inverted"), zero).alias("inverted"),
        F.coalesce(F.sum("_unknown"), zero).alias("unknown_values"),
        F.coalesce(F.sum(F.col("_n") - 1), zero).alias("duplicate_rows"),
    )


# Column of a report -> what a value above zero means.
FAILURES: Mapping[str, str] = {
    "null_rows": "rows lack a required value",
    "duplicate_rows": "rows repeat a key",
    "series_with_gaps": "series miss days inside their span",
    "inverted": "intervals end before they start",
    "unknown_values": "values are outside the vocabulary",
}


def require(report: DataFrame, allow: Sequence[str] = ()) -> Row:
    """Run a report and raise ``GateError`` for an empty batch or any failed check.

    ``allow`` names checks that may fail. Returns the report row.
    """
    row = report.first()
    found = []
    if row["rows"] == 0:
        found.append("the batch is empty")
    for column, meaning in FAILURES.items():
        if column in row.asDict() and column not in allow and row[column] > 0:
            found.append(f"{row[column]} {meaning}")
    if found:
        raise GateError("; ".join(found))
    return row


def _source_rows(source: DataFrame, columns: Sequence[str]) -> Column:
    """Rows of the source, counted on the columns its view reads.

    The count and the view then need the same shuffle of the roll-up, which Spark runs once:
    the facts are scanned once for both. Without its columns the count would scan them again.
    """
    read = F.max(F.xxhash64(*columns))
    return source.agg(F.when(read.isNull(), F.lit(0)).otherwise(F.count(F.lit(1)))).scalar()


def baseline_integrity(
    source: DataFrame, view: DataFrame, metric: str, weeks: int = 4, day: str = "day"
) -> DataFrame:
    """Row parity with the source, incomplete bases, NULLs that have no reason."""
    complete = F.col("base_weeks") == weeks
    return view.agg(
        F.count(F.lit(1)).alias("view_rows"),
        count_where(F.col("base_weeks") < weeks).alias("incomplete_bases"),
        count_where(complete & F.col(f"{metric}_pct").isNull()).alias("unexpected_nulls"),
    ).withColumn("source_rows", _source_rows(source, [day, metric]))


def lag_integrity(source: DataFrame, view: DataFrame, day: str = "day") -> DataFrame:
    """Row parity with the source, days without a partner, weekday mismatches."""
    paired = F.col("previous_day").isNotNull()
    moved = F.dayofweek(day) != F.dayofweek("previous_day")
    return view.agg(
        F.count(F.lit(1)).alias("view_rows"),
        count_where(~paired).alias("without_partner"),
        count_where(paired & moved).alias("weekday_mismatches"),
    ).withColumn("source_rows", _source_rows(source, source.columns))
