"""Distributions, positions within history, lists of exceedances."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.distribution import (
    distribution,
    exceedances,
    position_by_window,
    position_in_history,
    weekday_means,
)
from tideline.operators.variation import lag_variation, rolling_weekday_baseline
from tideline.plans import sql as q
from tideline.plans.registry import query
from tideline.plans.tables import (
    EVENT_DAY,
    HISTORY,
    HISTORY_12M,
    HISTORY_24M,
    METRICS,
    TARGETS,
    sales,
    shipments,
)
from tideline.plans.variations import dates

Period = tuple[date, date]
THROUGH_TARGETS = (HISTORY_24M[0], TARGETS[1])

BASELINE = q.baseline(q.shipments())
YEARLY = q.yearly(q.shipments())


def _baseline(spark: SparkSession, sf_dir: str, *keys: str, only: Period | None = None) -> DataFrame:
    series = shipments(spark, sf_dir, keys)
    return rolling_weekday_baseline(series, METRICS, keys, only=only, prove=True)


def _by_year_sql(source: str, metric: str, keys: tuple[str, ...] = ()) -> str:
    return f"""
    SELECT {q.key_list(keys)}CAST(year(day) AS INTEGER) AS year, count(*) AS days,
           {q.percentiles(metric)},
           {q.share_where(f'{metric} <= -10')} AS pct_days_low,
           {q.share_where(f'{metric} >= 10')} AS pct_days_high
    FROM ({source}) WHERE {metric} IS NOT NULL AND day <= DATE '{EVENT_DAY}'
    GROUP BY ALL"""


@query(f"{_by_year_sql(BASELINE, 'quantity_pct')} ORDER BY year")
def distribution_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("day").alias("year")
    return distribution(
        _baseline(spark, sf_dir), "quantity_pct", [year], through=EVENT_DAY
    ).orderBy("year")


@query(f"{_by_year_sql(BASELINE, 'value_pct')} ORDER BY year")
def distribution_by_year_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question for the amount instead of the count."""
    year = F.year("day").alias("year")
    return distribution(
        _baseline(spark, sf_dir), "value_pct", [year], through=EVENT_DAY
    ).orderBy("year")


@query(
    _by_year_sql(
        q.baseline(q.shipments(["l_suppkey"]), ["l_suppkey"], "calendar"),
        "value_pct",
        ("l_suppkey",),
    )
)
def distribution_by_supplier_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_suppkey"]
    series = rolling_weekday_baseline(
        shipments(spark, sf_dir, keys), METRICS, keys, frame="calendar"
    )
    year = F.year("day").alias("year")
    return distribution(series, "value_pct", [year], keys, through=EVENT_DAY)


SUPPLIERS_SQL = q.baseline(q.shipments(["l_suppkey"]), ["l_suppkey"], "calendar")


@query(
    f"""
    SELECT weekday, count(*) AS days, {q.percentiles('value_pct')},
           {q.share_where('value_pct <= -10')} AS pct_days_low,
           {q.share_where('value_pct >= 10')} AS pct_days_high
    FROM ({SUPPLIERS_SQL}) WHERE value_pct IS NOT NULL GROUP BY ALL"""
)
def distribution_across_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series together: few and very large groups, folded on the map side."""
    keys = ["l_suppkey"]
    series = rolling_weekday_baseline(
        shipments(spark, sf_dir, keys), METRICS, keys, frame="calendar"
    )
    return distribution(series, "value_pct", ["weekday"])


def _by_weekday_sql(source: str, metric: str, period: tuple[date, date]) -> str:
    return f"""
    SELECT weekday, count(*) AS days, {q.percentiles(metric)},
           {q.share_where(f'{metric} <= -10')} AS pct_days_low,
           count(*) FILTER (WHERE {metric} <= -10) AS days_low
    FROM ({source}) WHERE day BETWEEN {dates(period)}
    GROUP BY ALL ORDER BY weekday"""


@query(_by_weekday_sql(BASELINE, "quantity_pct", HISTORY_12M))
def distribution_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution(
        _baseline(spark, sf_dir, only=HISTORY_12M),
        "quantity_pct",
        ["weekday"],
        high=None,
        count_low=True,
        only_known=False,
        period=HISTORY_12M,
    ).orderBy("weekday")


WITH_UNKNOWN = (date(1995, 1, 1), date(1996, 6, 30))


@query(_by_weekday_sql(YEARLY, "quantity_yoy_pct", WITH_UNKNOWN))
def distribution_with_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period whose first year has no variation: those days stay in the count."""
    return distribution(
        lag_variation(shipments(spark, sf_dir), METRICS, only=WITH_UNKNOWN),
        "quantity_yoy_pct",
        ["weekday"],
        high=None,
        count_low=True,
        only_known=False,
        period=WITH_UNKNOWN,
    ).orderBy("weekday")


def _position_sql(
    source: str,
    metric: str,
    keys: tuple[str, ...] = (),
    targets: tuple[date, date] = TARGETS,
    wide: tuple[date, date] = HISTORY_24M,
    narrow: tuple[date, date] = HISTORY_12M,
) -> str:
    """The pairing of every target with its history, as a self-join."""
    k = "".join(f"n.{c}, " for c in keys)
    match = "".join(f" AND h.{c} = n.{c}" for c in keys)
    worse = f"h.{metric} <= n.{metric}"
    recent = f"h.day >= DATE '{narrow[0]}'"
    return f"""
    SELECT {k}n.day, n.weekday, n.{metric},
           count(CASE WHEN {recent} THEN 1 END) AS days_12m,
           {q.share_where(worse, recent)} AS pct_at_or_below_12m,
           count(*) AS days_24m,
           {q.share_where(worse)} AS pct_at_or_below_24m
    FROM ({source}) n JOIN ({source}) h
      ON h.weekday = n.weekday{match} AND h.day BETWEEN {dates(wide)}
    WHERE n.day BETWEEN {dates(targets)}
    GROUP BY ALL"""


@query(f"{_position_sql(BASELINE, 'quantity_pct')} ORDER BY n.day", "position_in_history")
def position_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_in_history(
        _baseline(spark, sf_dir, only=THROUGH_TARGETS), "quantity_pct", TARGETS, HISTORY
    ).orderBy("day")


@query(f"{_position_sql(BASELINE, 'value_pct')} ORDER BY n.day", "position_in_history_value")
def position_of_targets_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_in_history(
        _baseline(spark, sf_dir, only=THROUGH_TARGETS), "value_pct", TARGETS, HISTORY
    ).orderBy("day")


@query(f"{_position_sql(YEARLY, 'quantity_yoy_pct')} ORDER BY n.day", "position_in_history_yoy")
def position_of_targets_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = lag_variation(
        shipments(spark, sf_dir), METRICS, only=THROUGH_TARGETS
    )
    return position_in_history(yearly, "quantity_yoy_pct", TARGETS, HISTORY).orderBy("day")


SUPPLIER_BASELINE = q.baseline(q.shipments(["l_suppkey"]), ["l_suppkey"], "calendar", 8)


@query(
    _position_sql(
        f"SELECT * FROM ({SUPPLIER_BASELINE})",
        "value_pct",
        ("l_suppkey",),
        (date(2001, 6, 30), date(2001, 8, 31)),
    )
)
def position_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many targets per series: each is ranked, none is paired with its history."""
    keys = ["l_suppkey"]
    targets = (date(2001, 6, 30), date(2001, 8, 31))
    series = rolling_weekday_baseline(
        shipments(spark, sf_dir, keys), METRICS, keys, weeks=8, frame="calendar",
        only=(HISTORY_24M[0], targets[1]),
    )
    return position_in_history(series, "value_pct", targets, HISTORY, keys)


DROP_COLUMNS = ("day", "weekday", "quantity", "quantity_mean", "quantity_pct")


@query(
    f"""
    SELECT day, weekday, quantity, quantity_mean, quantity_pct FROM ({BASELINE})
    WHERE day BETWEEN {dates(HISTORY_24M)} AND weekday IN (6, 7) AND quantity_pct <= -10
    ORDER BY day"""
)
def weekend_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exceedances(
        _baseline(spark, sf_dir, only=HISTORY_24M), "quantity_pct", -10, (6, 7), HISTORY_24M
    ).select(*DROP_COLUMNS)


CUTS = {
    f"{months}m": (date(2001 - months // 12, 6 if months % 12 == 0 else 12, 30), EVENT_DAY)
    for months in (6, 12, 18, 24, 36, 48, 60)
}
CUTS["6m"] = (date(2000, 12, 30), EVENT_DAY)
CUTS["18m"] = (date(1999, 12, 30), EVENT_DAY)
CUTS_SQL = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, (a, b) in CUTS.items())


@query(
    f"""
    SELECT n.l_returnflag, n.day, n.weekday, n.value_pct, c.name AS window,
           c.first AS window_start, c.last AS window_end, count(*) AS days,
           {q.share_where('h.value_pct <= n.value_pct')} AS pct_at_or_below
    FROM ({q.baseline(q.shipments(['l_returnflag']), ['l_returnflag'])}) n
    JOIN ({q.baseline(q.shipments(['l_returnflag']), ['l_returnflag'])}) h
      ON h.weekday = n.weekday AND h.l_returnflag = n.l_returnflag
    JOIN (VALUES {CUTS_SQL}) c(name, first, last) ON h.day BETWEEN c.first AND c.last
    WHERE n.day BETWEEN {dates(TARGETS)}
    GROUP BY ALL"""
)
def ext_window_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag"]
    period = (min(first for first, _ in CUTS.values()), TARGETS[1])
    return position_by_window(
        _baseline(spark, sf_dir, *keys, only=period), "value_pct", TARGETS, CUTS, keys
    )


def _weekday_means_sql(source: str, where: str = "true", keys: tuple[str, ...] = ()) -> str:
    return f"""
    SELECT {q.key_list(keys)}weekday, count(*) AS days,
           {q.money(q.ratio('sum(quantity * 100)', 'count(quantity)'))} AS quantity_mean,
           {q.money(q.ratio('sum(cents)', 'count(cents)'))} AS value_mean
    FROM ({source}) WHERE {where} GROUP BY ALL"""


@query(_weekday_means_sql(q.shipments()))
def ext_weekday_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekday_means(shipments(spark, sf_dir), METRICS)


@query(_weekday_means_sql(q.sales(["o_custkey"]), keys=("o_custkey",)))
def ext_weekday_means_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["o_custkey"]
    return weekday_means(sales(spark, sf_dir, keys), METRICS, keys)
