"""Comparisons adjusted for holidays, month cycle, trend and marker dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.adjusted import (
    before_after,
    cycle_profile,
    trend_deviation,
    with_business_days,
    with_month_cycle,
)
from tideline.operators.distribution import position_in_history
from tideline.operators.variation import rolling_weekday_baseline
from tideline.plans import sql as q
from tideline.plans.registry import query
from tideline.plans.tables import (
    EVENT_DAY,
    HISTORY_24M,
    METRICS,
    TARGETS,
    is_fixed_holiday,
    sales,
    shipments,
)
from tideline.plans.variations import dates


@query(
    f"""
    SELECT day, quantity, value, weekday, holiday, business_day,
           CASE WHEN business_day THEN CAST(sum(business_day::INTEGER) OVER (
             PARTITION BY l_returnflag, date_trunc('month', day) ORDER BY day) AS BIGINT) END
             AS business_day_number,
           CAST(sum(business_day::INTEGER) OVER (
             PARTITION BY l_returnflag, date_trunc('month', day)) AS BIGINT)
             AS business_days_in_month, l_returnflag
    FROM (SELECT *, weekday <= 5 AND NOT holiday AS business_day
          FROM (SELECT *, strftime(day, '%m-%d') IN ('01-01', '05-01', '12-25') AS holiday
                FROM ({q.shipments(['l_returnflag'])})))"""
)
def ext_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag"]
    return with_business_days(shipments(spark, sf_dir, keys), is_fixed_holiday("day"), keys)


@query(
    f"""
    SELECT day, quantity, value, weekday, day IN (SELECT day FROM ({q.sales()}) WHERE quantity % 7 = 0) AS holiday,
           weekday <= 5 AND day NOT IN (SELECT day FROM ({q.sales()}) WHERE quantity % 7 = 0) AS business_day,
           CASE WHEN weekday <= 5 AND day NOT IN (SELECT day FROM ({q.sales()}) WHERE quantity % 7 = 0)
             THEN CAST(sum((weekday <= 5 AND day NOT IN (SELECT day FROM ({q.sales()}) WHERE quantity % 7 = 0))::INTEGER)
               OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS BIGINT) END AS business_day_number,
           CAST(sum((weekday <= 5 AND day NOT IN (SELECT day FROM ({q.sales()}) WHERE quantity % 7 = 0))::INTEGER)
             OVER (PARTITION BY date_trunc('month', day)) AS BIGINT) AS business_days_in_month
    FROM ({q.shipments()})"""
)
def ext_business_days_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free days kept in a table of their own."""
    free = sales(spark, sf_dir).filter(F.col("quantity") % 7 == 0).select("day")
    return with_business_days(shipments(spark, sf_dir), free)


CYCLE = """
    day(day)::INTEGER AS day_of_month,
    CAST(last_day(day) - day AS INTEGER) AS days_to_month_end,
    CAST((day(day) - 1) // 7 + 1 AS INTEGER) AS month_slot,
    CASE WHEN day(day) <= 5 THEN 'start' WHEN last_day(day) - day < 5 THEN 'end'
         ELSE 'middle' END AS month_phase"""


@query(
    f"""
    SELECT day, quantity, value, {CYCLE}, day(day) IN (5, 20) AS pay_day
    FROM ({q.shipments()})"""
)
def ext_month_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_month_cycle(shipments(spark, sf_dir), pay_days=(5, 20))


@query(
    f"""
    SELECT o_custkey, month_phase, weekday, count(*) AS days,
           {q.money(q.ratio('sum(quantity * 100)', 'count(*)'))} AS quantity_mean,
           {q.money(q.ratio('sum(cents)', 'count(*)'))} AS value_mean
    FROM (SELECT *, {CYCLE} FROM ({q.sales(['o_custkey'])}))
    GROUP BY ALL"""
)
def ext_cycle_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["o_custkey"]
    return cycle_profile(sales(spark, sf_dir, keys), METRICS, keys)


BASELINE = q.baseline(q.shipments())


@query(
    f"""
    WITH b AS (SELECT *, {CYCLE} FROM ({BASELINE}))
    SELECT n.day, n.weekday, n.month_slot, n.quantity_pct, count(*) AS days_24m,
           {q.share_where('h.quantity_pct <= n.quantity_pct')} AS pct_at_or_below_24m
    FROM b n JOIN b h ON h.weekday = n.weekday AND h.month_slot = n.month_slot
      AND h.day BETWEEN {dates(HISTORY_24M)}
      AND date_trunc('month', h.day) NOT IN (DATE '2001-06-01', DATE '2001-07-01')
    WHERE n.day BETWEEN {dates(TARGETS)}
    GROUP BY ALL ORDER BY n.day"""
)
def ext_position_in_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the same weekday at the same place in months without the event."""
    period = (HISTORY_24M[0], TARGETS[1])
    series = rolling_weekday_baseline(shipments(spark, sf_dir), METRICS, only=period, prove=True)
    event_months = F.trunc("day", "month").isin(date(2001, 6, 1), date(2001, 7, 1))
    return position_in_history(
        with_month_cycle(series),
        "quantity_pct",
        TARGETS,
        {"24m": HISTORY_24M},
        strata=["weekday", "month_slot"],
        history=~event_months,
    ).orderBy("day")


def _trend_sql(source: str, metric: str, keys: tuple[str, ...], group: str) -> str:
    first = f"DATE '{HISTORY_24M[0]}'"
    y = f"CASE WHEN day BETWEEN {dates(HISTORY_24M)} THEN {metric}::DOUBLE END"
    x = f"(day - {first})::DOUBLE"
    k = q.key_list(keys)
    cents = q.hundredths(metric)
    return f"""
    SELECT {k}day, quantity, value, {'weekday, ' if 'weekday' in group else ''}
           round(slope, 6) AS trend_slope, trend_expected,
           {q.percent(q.change(cents, q.hundredths('trend_expected')))} AS trend_pct
    FROM (SELECT *, {q.from_double(f'intercept + slope * {x}', 'DECIMAL(18,2)')} AS trend_expected
          FROM (SELECT *, regr_slope({y}, {x}) OVER g AS slope,
                       regr_intercept({y}, {x}) OVER g AS intercept
                FROM ({source}) WINDOW g AS (PARTITION BY {group})))"""


@query(_trend_sql(q.shipments(), "value", (), "weekday"))
def ext_trend_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend_deviation(shipments(spark, sf_dir), "value", HISTORY_24M)


@query(_trend_sql(q.shipments(["l_returnflag"]), "quantity", ("l_returnflag",), "l_returnflag"))
def ext_trend_deviation_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag"]
    series = shipments(spark, sf_dir, keys)
    return trend_deviation(series, "quantity", HISTORY_24M, keys, by_weekday=False)


MARKERS = {"announcement": EVENT_DAY, "enforcement": date(2001, 7, 10)}
MARKERS_SQL = ", ".join(f"('{n}', DATE '{d}')" for n, d in MARKERS.items())


def _before_after_sql(keys: tuple[str, ...], before: int, after: int, weekday: bool) -> str:
    k = q.key_list(keys)
    w = "weekday, " if weekday else ""
    early, late = "FILTER (WHERE day <= marker_day)", "FILTER (WHERE day > marker_day)"
    q_early = q.ratio(f"sum(quantity * 100) {early}", f"count(*) {early}")
    q_late = q.ratio(f"sum(quantity * 100) {late}", f"count(*) {late}")
    v_early = q.ratio(f"sum(cents) {early}", f"count(*) {early}")
    v_late = q.ratio(f"sum(cents) {late}", f"count(*) {late}")
    return f"""
    SELECT {k}{w}marker, marker_day, days_before, days_after,
           {q.money('qb')} AS quantity_before, {q.money('qa')} AS quantity_after,
           {q.money('vb')} AS value_before, {q.money('va')} AS value_after,
           {q.percent(q.change('qa', 'qb'))} AS quantity_change_pct,
           {q.percent(q.change('va', 'vb'))} AS value_change_pct
    FROM (SELECT {k}{w}marker, marker_day, count(*) {early} AS days_before,
                 count(*) {late} AS days_after, {q_early} AS qb, {q_late} AS qa,
                 {v_early} AS vb, {v_late} AS va
          FROM ({q.shipments(keys)})
          JOIN (VALUES {MARKERS_SQL}) m(marker, marker_day)
            ON day BETWEEN marker_day - {before - 1} AND marker_day + {after}
          GROUP BY ALL)"""


@query(_before_after_sql((), 28, 28, False))
def ext_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return before_after(shipments(spark, sf_dir), METRICS, MARKERS, 28, 28)


@query(_before_after_sql(("l_returnflag",), 28, 3, True))
def ext_before_after_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few days after the marker: some weekdays have none."""
    keys = ["l_returnflag"]
    series = shipments(spark, sf_dir, keys)
    return before_after(series, METRICS, MARKERS, 28, 3, keys, by_weekday=True)
