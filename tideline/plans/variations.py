"""Series, baselines, yearly comparison and what is read directly from them."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.compare import inline, reconcile, side_by_side as join_side_by_side
from tideline.operators.distribution import base_detail, weekly_trend, within
from tideline.operators.series import densify, latest_days as newest, with_calendar
from tideline.operators.variation import (
    both_variations,
    lag_variation,
    look_back,
    period_total,
    rolling_weekday_baseline,
    variation_vs_recent,
)
from tideline.plans import sql as q
from tideline.plans.registry import query
from tideline.plans.tables import (
    METRICS,
    RECENT_WEEKS,
    SERIES_SPAN,
    TARGETS,
    TREND_WEEKS,
    activity,
    sales,
    shipments,
)

WEEKDAY_NAMES = "['monday','tuesday','wednesday','thursday','friday','saturday','sunday']"


def dates(period: tuple[date, date]) -> str:
    return f"DATE '{period[0]}' AND DATE '{period[1]}'"


@query(f"SELECT * EXCLUDE (cents, weekday) FROM ({q.shipments()})")
def shipments_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipments(spark, sf_dir)


@query(
    f"""
    SELECT day, quantity, value, CAST(year(day) AS INTEGER) AS year,
           CAST(month(day) AS INTEGER) AS month, CAST(day(day) AS INTEGER) AS day_of_month,
           weekday, {WEEKDAY_NAMES}[weekday] AS weekday_name, weekday >= 6 AS weekend
    FROM ({q.shipments()})"""
)
def calendar_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_calendar(shipments(spark, sf_dir))


@query(
    f"""
    WITH s AS ({q.sales(['o_orderpriority'])}),
         span AS (SELECT o_orderpriority, unnest(generate_series(min(day), max(day),
                    INTERVAL 1 DAY))::DATE AS day FROM s GROUP BY 1)
    SELECT span.o_orderpriority, span.day, coalesce(s.quantity, 0) AS quantity, s.value,
           s.day IS NULL AS inserted
    FROM span LEFT JOIN s USING (o_orderpriority, day)"""
)
def filled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["o_orderpriority"]
    return densify(sales(spark, sf_dir, keys), keys=keys, fill={"quantity": 0})


@query(
    f"""
    WITH s AS ({q.sales(['o_orderpriority'])}),
         span AS (SELECT o_orderpriority, d::DATE AS day
                  FROM (SELECT DISTINCT o_orderpriority FROM s),
                       generate_series(DATE '{SERIES_SPAN[0]}', DATE '{SERIES_SPAN[1]}',
                                       INTERVAL 1 DAY) t(d))
    SELECT span.o_orderpriority, span.day, coalesce(s.quantity, 0) AS quantity,
           coalesce(s.value, 0) AS value, s.day IS NULL AS inserted
    FROM span LEFT JOIN s USING (o_orderpriority, day)"""
)
def filled_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["o_orderpriority"]
    start, end = SERIES_SPAN
    return densify(
        sales(spark, sf_dir, keys), keys=keys, start=start, end=end,
        fill={"quantity": 0, "value": 0},
    )


@query(f"SELECT * FROM ({q.baseline(q.shipments())})")
def rolling_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_weekday_baseline(shipments(spark, sf_dir), METRICS)


@query(f"SELECT * FROM ({q.baseline(q.shipments(['l_returnflag']), ['l_returnflag'])})")
def rolling_baseline_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag"]
    return rolling_weekday_baseline(shipments(spark, sf_dir, keys), METRICS, keys)


@query(
    f"SELECT * FROM ({q.baseline(q.shipments(['l_suppkey']), ['l_suppkey'], 'calendar')})"
)
def rolling_baseline_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse series, many keys: the frame counts weeks, not rows."""
    keys = ["l_suppkey"]
    return rolling_weekday_baseline(
        shipments(spark, sf_dir, keys), METRICS, keys, frame="calendar"
    )


@query(f"SELECT * FROM ({q.baseline(q.sales(), frame='calendar')})")
def rolling_baseline_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_weekday_baseline(sales(spark, sf_dir), METRICS, frame="calendar")


@query(
    f"""SELECT * FROM ({q.baseline(q.shipments(), frame='calendar')})
    WHERE day BETWEEN {dates(TARGETS)}"""
)
def rolling_baseline_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only some result days: the look-back bounds what the scan reads."""
    return rolling_weekday_baseline(
        shipments(spark, sf_dir), METRICS, frame="calendar", only=TARGETS
    )


@query(
    f"""SELECT * FROM ({q.baseline(q.series('events', 'ts', 'value', ['event_type']),
                                   ['event_type'])})"""
)
def rolling_baseline_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days per type: most bases are incomplete."""
    return rolling_weekday_baseline(activity(spark, sf_dir), METRICS, ["event_type"])


@query(f"SELECT * FROM ({q.yearly(q.shipments())})")
def yoy_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag_variation(shipments(spark, sf_dir), METRICS)


@query(f"SELECT * FROM ({q.yearly(q.shipments(['l_returnflag']), ['l_returnflag'])})")
def yoy_variation_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag"]
    return lag_variation(shipments(spark, sf_dir, keys), METRICS, keys)


@query(f"SELECT * FROM ({q.yearly(q.sales(), days=365)})")
def same_date_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """365 days: the calendar date instead of the weekday, on a series with gaps."""
    return lag_variation(sales(spark, sf_dir), METRICS, days=365)


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline and yearly variation of the same series, in one pass over it."""
    return both_variations(shipments(spark, sf_dir), METRICS)


BOTH_SQL = f"""
    SELECT y.day, y.weekday, y.previous_day, b.quantity_pct, y.quantity_yoy_pct,
           b.value_pct, y.value_yoy_pct
    FROM ({q.yearly(q.shipments())}) y JOIN ({q.baseline(q.shipments())}) b USING (day)"""
BOTH_COLUMNS = (
    "day", "weekday", "previous_day", "quantity_pct", "quantity_yoy_pct", "value_pct",
    "value_yoy_pct",
)


@query(f"{BOTH_SQL} WHERE day BETWEEN {dates(TARGETS)} ORDER BY day")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = both_variations(shipments(spark, sf_dir), METRICS, only=TARGETS)
    return found.select(*BOTH_COLUMNS).orderBy("day")


@query(f"{BOTH_SQL} WHERE day BETWEEN {dates(TARGETS)} ORDER BY day")
def side_by_side_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results that are there already, joined by their day."""
    series = shipments(spark, sf_dir)
    yearly = lag_variation(series, METRICS, only=TARGETS)
    recent = rolling_weekday_baseline(series, METRICS, only=TARGETS, prove=True)
    joined = join_side_by_side(yearly, recent.select("day", "quantity_pct", "value_pct"), ["day"])
    return joined.select(*BOTH_COLUMNS).orderBy("day")


@query(BOTH_SQL)
def both_methods_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir).select(*BOTH_COLUMNS)


PUBLISHED = [
    (date(2001, 6, 30), 26, Decimal("18.0")),
    (date(2001, 7, 1), 21, Decimal("-9.0")),
    (date(2001, 7, 2), 26, Decimal("5.1")),
]
PUBLISHED_SQL = ", ".join(f"(DATE '{d}', {n}, {p})" for d, n, p in PUBLISHED)


@query(
    f"""
    SELECT b.day, b.quantity AS quantity_calculated, n.quantity_published,
           b.quantity_mean, b.quantity_pct AS pct_calculated,
           CAST(n.pct_published AS DECIMAL(3,1)) AS pct_published, b.value_pct
    FROM ({q.baseline(q.shipments())}) b
    JOIN (VALUES {PUBLISHED_SQL}) n(day, quantity_published, pct_published) ON b.day = n.day
    ORDER BY b.day"""
)
def published_vs_calculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = inline(
        spark, PUBLISHED, "day date, quantity_published int, pct_published decimal(3,1)"
    )
    told = [row[0] for row in PUBLISHED]
    calculated = rolling_weekday_baseline(
        shipments(spark, sf_dir), METRICS, only=(min(told), max(told)), prove=True
    )
    return (
        reconcile(calculated, published, ["day"])
        .select(
            "day",
            F.col("quantity").alias("quantity_calculated"),
            "quantity_published",
            "quantity_mean",
            F.col("quantity_pct").alias("pct_calculated"),
            "pct_published",
            "value_pct",
        )
        .orderBy("day")
    )


VS_RECENT_SQL = f"""
    SELECT day, weekday, quantity_yoy_pct,
           {q.percent(q.ratio('s', 'n'))} AS quantity_yoy_pct_recent_mean,
           {q.percent(q.ratio('c * n - s', 'n'))} AS quantity_yoy_pct_gap_pp
    FROM (SELECT *, sum(c) OVER w AS s, count(c) OVER w AS n
          FROM (SELECT *, {q.hundredths('quantity_yoy_pct')} AS c
                FROM ({q.yearly(q.shipments())}))
          WINDOW w AS (PARTITION BY weekday ORDER BY day
                       ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"""
VS_RECENT_COLUMNS = (
    "day", "weekday", "quantity_yoy_pct", "quantity_yoy_pct_recent_mean",
    "quantity_yoy_pct_gap_pp",
)


@query(VS_RECENT_SQL)
def yoy_vs_recent_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = lag_variation(shipments(spark, sf_dir), METRICS)
    return variation_vs_recent(yearly, "quantity_yoy_pct").select(*VS_RECENT_COLUMNS)


@query(f"SELECT * FROM ({VS_RECENT_SQL}) WHERE day BETWEEN {dates(TARGETS)} ORDER BY day")
def yoy_vs_recent_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = shipments(spark, sf_dir)
    since = look_back(series, TARGETS)
    yearly = lag_variation(series, METRICS, only=since and (since, TARGETS[1]))
    compared = variation_vs_recent(yearly, "quantity_yoy_pct").select(*VS_RECENT_COLUMNS)
    return compared.filter(within("day", TARGETS)).orderBy("day")


@query(
    f"""
    SELECT weekday, day, previous_day, quantity_yoy_pct, value_yoy_pct
    FROM ({q.yearly(q.shipments())})
    WHERE weekday IN (6, 7, 1) AND day BETWEEN {dates(RECENT_WEEKS)}
    ORDER BY weekday, day"""
)
def yoy_base_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = lag_variation(shipments(spark, sf_dir), METRICS, only=RECENT_WEEKS)
    return base_detail(yearly, (6, 7, 1), RECENT_WEEKS).select(
        "weekday", "day", "previous_day", "quantity_yoy_pct", "value_yoy_pct"
    )


def _mean_pct(metric: str) -> str:
    cents = q.hundredths(metric)
    whole = q.ratio(f"sum({cents})", f"count({metric})")
    return f"{q.dec(whole, 2, 'DECIMAL(11,2)')} AS {metric}_mean"


@query(
    f"""
    SELECT date_trunc('week', day)::TIMESTAMP AS week_start, count(*) AS days,
           {_mean_pct('quantity_yoy_pct')}, {_mean_pct('value_yoy_pct')}
    FROM ({q.yearly(q.shipments())}) WHERE day BETWEEN {dates(TREND_WEEKS)}
    GROUP BY ALL ORDER BY week_start"""
)
def yoy_weekly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = lag_variation(shipments(spark, sf_dir), METRICS, only=TREND_WEEKS)
    return weekly_trend(yearly, ["quantity_yoy_pct", "value_yoy_pct"], TREND_WEEKS).orderBy(
        "week_start"
    )


@query(
    f"""
    SELECT l_returnflag, date_trunc('week', day)::TIMESTAMP AS week_start, count(*) AS days,
           {_mean_pct('quantity_yoy_pct')}, {_mean_pct('value_yoy_pct')}
    FROM ({q.yearly(q.shipments(['l_returnflag']), ['l_returnflag'])})
    GROUP BY ALL"""
)
def yoy_weekly_trend_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag"]
    yearly = lag_variation(shipments(spark, sf_dir, keys), METRICS, keys)
    return weekly_trend(yearly, ["quantity_yoy_pct", "value_yoy_pct"], keys=keys)


@query(
    f"""SELECT * EXCLUDE (cents, weekday) FROM ({q.sales()}) ORDER BY day DESC LIMIT 14"""
)
def latest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(sales(spark, sf_dir), 14)


def _period_total_sql(keys: list[str]) -> str:
    k = q.key_list(keys)
    inner = q.baseline(q.shipments(keys), keys)
    q_base, v_base = "sum(quantity_mean)", "sum(value_mean)"
    return f"""
    SELECT {k}days, quantity_total, {q.dec('qb', 2, 'DECIMAL(28,2)')} AS quantity_base_total,
           {q.percent(q.change('quantity_total * 100', 'qb'))} AS quantity_total_pct,
           value_total, {q.dec('vb', 2, 'DECIMAL(28,2)')} AS value_base_total,
           {q.percent(q.change(q.hundredths('value_total'), 'vb'))} AS value_total_pct
    FROM (SELECT {k}count(*) AS days, CAST(sum(quantity) AS BIGINT) AS quantity_total,
                 CASE WHEN count(*) = count(quantity_mean) THEN {q.hundredths(q_base)} END AS qb,
                 CAST(sum(value) AS DECIMAL(28,2)) AS value_total,
                 CASE WHEN count(*) = count(value_mean) THEN {q.hundredths(v_base)} END AS vb
          FROM ({inner}) WHERE day BETWEEN {dates(TARGETS)}
          {'GROUP BY ' + ', '.join(keys) if keys else ''})"""


@query(_period_total_sql(["l_returnflag"]))
def ext_period_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag"]
    series = rolling_weekday_baseline(
        shipments(spark, sf_dir, keys), METRICS, keys, only=TARGETS, prove=True
    )
    return period_total(series, METRICS, TARGETS, keys)
