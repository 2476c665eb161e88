"""The daily series and periods the queries work on."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.numbers import cents_sum
from tideline.operators.series import daily_series

METRICS = ("quantity", "value")

# Parameters, fixed before any result was seen.
EVENT_DAY = date(2001, 6, 29)
TARGETS = (date(2001, 6, 30), date(2001, 7, 2))
HISTORY_12M = (date(2000, 6, 30), EVENT_DAY)
HISTORY_24M = (date(1999, 6, 30), EVENT_DAY)
HISTORY = {"12m": HISTORY_12M, "24m": HISTORY_24M}
RECENT_WEEKS = (date(2001, 5, 5), date(2001, 7, 2))
TREND_WEEKS = (date(2001, 4, 23), date(2001, 7, 2))
SERIES_SPAN = (date(1995, 1, 1), date(2001, 12, 31))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shipments(spark: SparkSession, sf_dir: str, keys: Sequence[str] = ()) -> DataFrame:
    """Line items per ship day: how many, and for how much."""
    metrics = {"quantity": F.count(F.lit(1)), "value": cents_sum("l_extendedprice")}
    return daily_series(read(spark, sf_dir, "lineitem"), "l_shipdate", metrics, keys)


def sales(spark: SparkSession, sf_dir: str, keys: Sequence[str] = ()) -> DataFrame:
    """Orders per order day: how many, and for how much."""
    metrics = {"quantity": F.count(F.lit(1)), "value": cents_sum("o_totalprice")}
    return daily_series(read(spark, sf_dir, "orders"), "o_orderdate", metrics, keys)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day."""
    metrics = {"quantity": F.count(F.lit(1)), "value": cents_sum("value")}
    return daily_series(read(spark, sf_dir, "events"), "ts", metrics, ["event_type"])


def campaign_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event windows found in the orders: per priority and month, the week that
    starts on the month's best day of sales (the later day decides a tie).

    The orders are rolled up to days first; picking the best day then works on
    at most 31 rows per priority and month.
    """
    best = F.max(F.struct("value", "day", "quantity"))
    return (
        sales(spark, sf_dir, ["o_orderpriority"])
        .groupBy(F.col("o_orderpriority").alias("kind"), F.trunc("day", "month").alias("month"))
        .agg(best.alias("best"))
        .select(
            F.col("best.day").alias("start_day"),
            F.date_add("best.day", 6).alias("end_day"),
            "kind",
            F.concat(F.col("best.quantity").cast("string"), F.lit(" orders")).alias("source"),
        )
    )


def is_fixed_holiday(day: str) -> Column:
    """Whether a day is one of the fixed-date holidays."""
    return F.date_format(day, "MM-dd").isin("01-01", "05-01", "12-25")
