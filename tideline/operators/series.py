"""Building a daily series: roll-up, calendar columns, gap filling, newest days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import WEEKDAYS_EN, is_weekend, iso_weekday, weekday_label


def daily_series(
    facts: DataFrame,
    date_column: str,
    metrics: Mapping[str, Column],
    keys: Sequence[str] = (),
    day: str = "day",
) -> DataFrame:
    """One row per (keys, day) from a fact table.

    This is the only stage that touches the facts. Counts and sums combine on
    the map side, so a key or a day that holds a third of all rows reaches the
    shuffle as one partial row per task. A later filter on ``day`` moves below
    the aggregate and into the scan. Instants take their day in the session time
    zone; timestamps without a zone take it as written.
    """
    bucket = F.col(date_column).cast("date").alias(day)
    aggregates = [metric.alias(name) for name, metric in metrics.items()]
    return facts.groupBy(*keys, bucket).agg(*aggregates)


def with_weekday(df: DataFrame, day: str = "day", weekday: str = "weekday") -> DataFrame:
    """Add the ISO weekday unless it is already there."""
    return df if weekday in df.columns else df.withColumn(weekday, iso_weekday(day))


def with_calendar(
    df: DataFrame, day: str = "day", labels: Sequence[str] = WEEKDAYS_EN
) -> DataFrame:
    """Year, month, day of month, ISO weekday, its name and a weekend flag."""
    return with_weekday(df, day).withColumns(
        {
            "year": F.year(day),
            "month": F.month(day),
            "day_of_month": F.dayofmonth(day),
            "weekday_name": weekday_label("weekday", labels),
            "weekend": is_weekend("weekday"),
        }
    )


def densify(
    df: DataFrame,
    day: str = "day",
    keys: Sequence[str] = (),
    start: date | None = None,
    end: date | None = None,
    fill: Mapping[str, object] | None = None,
) -> DataFrame:
    """Insert a row for every missing day of each series.

    Each row emits itself and the empty days up to the next row, so one window
    pass over each series replaces a join against a date spine; a series has at
    most one row per calendar day. Without ``start``/``end`` each
    series keeps its own first and last day; with both, every series covers the whole
    period, also one whose days all lie outside it. A repeated day keeps all its rows.
    Inserted rows carry ``fill`` values, NULL elsewhere, and ``inserted = true``.
    """
    in_order = Window.partitionBy(*keys).orderBy(day)
    one = F.expr("INTERVAL 1 DAY")
    opens = F.lag(day).over(in_order).isNull()
    following = F.lead(day).over(in_order)
    reach = F.when(following.isNotNull(), F.greatest(F.date_sub(following, 1), day))
    first = F.col(day)
    if start is not None:
        first = F.when(opens, F.lit(start)).otherwise(F.greatest(day, F.lit(start)))
    if end is not None:
        reach = F.least(F.coalesce(reach, F.lit(end)), F.lit(end))
    else:
        reach = F.coalesce(reach, F.col(day))

    spread = df.withColumns({"_first": first, "_last": reach}).filter("_first <= _last").withColumn(
        "_day", F.explode(F.sequence("_first", "_last", one))
    )
    own = F.col("_day") == F.col(day)
    defaults = dict(fill or {})
    columns = []
    for name in df.columns:
        if name == day:
            columns.append(F.col("_day").alias(day))
        elif name in keys:
            columns.append(F.col(name))
        else:
            empty = F.lit(defaults[name]) if name in defaults else F.lit(None)
            kind = df.schema[name].dataType
            columns.append(F.when(own, F.col(name)).otherwise(empty.cast(kind)).alias(name))
    return spread.select(*columns, (~own).alias("inserted"))


def latest_days(
    df: DataFrame, n: int, day: str = "day", keys: Sequence[str] = ()
) -> DataFrame:
    """The n newest rows (a top-k: each task keeps n rows)."""
    return df.orderBy(F.desc(day), *keys).limit(n)
