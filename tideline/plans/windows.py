"""Event windows taken from the orders, and their effect on the shipments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.dates import span_days
from tideline.operators.adjusted import inside_outside
from tideline.operators.series import latest_days
from tideline.operators.windows import (
    expand_windows,
    flag_windows,
    merge_windows,
    window_profile as profile,
)
from tideline.plans import sql as q
from tideline.plans.registry import query
from tideline.plans.tables import campaign_windows, shipments

WINDOWS = f"""
    SELECT day AS start_day, day + 6 AS end_day, o_orderpriority AS kind,
           quantity || ' orders' AS source
    FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, date_trunc('month', day)
                                       ORDER BY cents DESC, day DESC) AS r
          FROM ({q.sales(['o_orderpriority'])})) WHERE r = 1"""


def days_sql(where: str) -> str:
    return f"""
    SELECT DISTINCT unnest(generate_series(start_day, end_day, INTERVAL 1 DAY))::DATE AS day
    FROM ({WINDOWS}) WHERE {where}"""


@query(f"SELECT start_day, end_day, kind, source FROM ({WINDOWS})")
def window_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign_windows(spark, sf_dir)


@query(
    f"""
    SELECT kind, count(*) AS windows, min(start_day) AS first_day, max(end_day) AS last_day
    FROM ({WINDOWS}) GROUP BY kind ORDER BY kind"""
)
def window_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(campaign_windows(spark, sf_dir)).orderBy("kind")


@query(days_sql("kind = '1-URGENT'"))
def window_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_windows(campaign_windows(spark, sf_dir), "1-URGENT")


@query(days_sql("true"))
def window_days_any_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all kinds overlap heavily; each day still appears once."""
    return expand_windows(campaign_windows(spark, sf_dir))


@query(
    f"""
    WITH days AS (
      SELECT DISTINCT kind,
             unnest(generate_series(start_day, end_day, INTERVAL 1 DAY))::DATE AS day
      FROM ({WINDOWS})),
    runs AS (SELECT kind, day, day - CAST(row_number() OVER (
               PARTITION BY kind ORDER BY day) AS INTEGER) AS run FROM days)
    SELECT kind, min(day) AS start_day, max(day) AS end_day,
           CAST(count(*) AS INTEGER) AS length
    FROM runs GROUP BY kind, run"""
)
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_windows(campaign_windows(spark, sf_dir), ["kind"])
    return merged.withColumn("length", span_days("start_day", "end_day"))


FLAGGED = f"""
    SELECT s.* , d.day IS NOT NULL AS in_window
    FROM ({q.shipments()}) s LEFT JOIN ({days_sql("kind = '1-URGENT'")}) d ON s.day = d.day"""


@query(
    f"""SELECT day, quantity, in_window FROM ({FLAGGED}) ORDER BY day DESC LIMIT 14"""
)
def window_flags_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag_windows(
        shipments(spark, sf_dir), campaign_windows(spark, sf_dir), "1-URGENT"
    )
    return latest_days(flagged.select("day", "quantity", "in_window"), 14)


@query(f"SELECT day, quantity, value, in_window FROM ({FLAGGED})")
def window_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_windows(
        shipments(spark, sf_dir),
        campaign_windows(spark, sf_dir),
        "1-URGENT",
    )


def _inside_outside_sql(metric: str, strata: str) -> str:
    return f"""
    SELECT days_inside, days_outside, {q.money('mi')} AS mean_inside,
           {q.money('mo')} AS mean_outside, {q.percent(q.change('mi', 'mo'))} AS naive_pct,
           {q.percent(q.change('actual', 'expected'))} AS adjusted_pct
    FROM (
      SELECT CAST(sum(ni) AS BIGINT) AS days_inside, CAST(sum(no) AS BIGINT) AS days_outside,
             {q.ratio('sum(si)', 'sum(ni)')} AS mi, {q.ratio('sum(so)', 'sum(no)')} AS mo,
             sum(si) FILTER (WHERE ni > 0 AND no > 0) AS actual,
             sum(ni * {q.ratio('so', 'no')}) FILTER (WHERE ni > 0 AND no > 0) AS expected
      FROM (SELECT {strata}, count(*) FILTER (WHERE in_window) AS ni,
                   count(*) FILTER (WHERE NOT in_window) AS no,
                   sum({metric}) FILTER (WHERE in_window) AS si,
                   sum({metric}) FILTER (WHERE NOT in_window) AS so
            FROM ({FLAGGED}) GROUP BY ALL))"""


@query(_inside_outside_sql("cents", "weekday"))
def ext_inside_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag_windows(
        shipments(spark, sf_dir),
        campaign_windows(spark, sf_dir),
        "1-URGENT",
    )
    return inside_outside(flagged, "value", "in_window")


@query(_inside_outside_sql("quantity * 100", "weekday, (day(day) - 1) // 7 AS slot"))
def ext_inside_outside_month_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted for weekday and for its place in the month."""
    flagged = flag_windows(
        shipments(spark, sf_dir),
        campaign_windows(spark, sf_dir),
        "1-URGENT",
    ).withColumn("slot", F.floor((F.dayofmonth("day") - 1) / 7))
    return inside_outside(flagged, "quantity", "in_window", strata=["weekday", "slot"])
