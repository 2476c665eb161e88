"""Quality checks as reports over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import quality
from tideline.operators.variation import lag_variation, rolling_weekday_baseline
from tideline.plans import sql as q
from tideline.plans.registry import query
from tideline.plans.tables import METRICS, campaign_windows, read, sales, shipments
from tideline.plans.windows import WINDOWS


@query(
    f"""
    SELECT count(*) AS rows,
           count(*) FILTER (WHERE previous_day IS NULL OR quantity_previous IS NULL) AS null_rows,
           count(*) FILTER (WHERE previous_day IS NULL) AS null_previous_day,
           count(*) FILTER (WHERE quantity_previous IS NULL) AS null_quantity_previous
    FROM ({q.yearly(q.shipments())})"""
)
def gate_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = lag_variation(shipments(spark, sf_dir), METRICS)
    return quality.null_report(yearly, ["previous_day", "quantity_previous"])


def _duplicates_sql(table: str, key: str) -> str:
    return f"""
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys,
           count(*) FILTER (WHERE n > 1) AS repeated_keys,
           CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})"""


@query(_duplicates_sql("lineitem", "l_orderkey, l_linenumber"))
def gate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_report(
        read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


@query(_duplicates_sql(f"({WINDOWS})", "start_day, kind"))
def gate_duplicate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_report(campaign_windows(spark, sf_dir), ["start_day", "kind"])


def _gaps_sql(source: str, keys: str = "") -> str:
    return f"""
    SELECT count(*) AS series, CAST(sum(n) AS BIGINT) AS rows,
           CAST(sum(d) AS BIGINT) AS days_in_span,
           count(*) FILTER (WHERE n <> d) AS series_with_gaps,
           count(*) FILTER (WHERE n <> d) = 0 AS contiguous
    FROM (SELECT count(*) AS n, max(day) - min(day) + 1 AS d FROM ({source}) {keys})"""


@query(_gaps_sql(q.sales()))
def gate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gap_report(sales(spark, sf_dir), folded=True)


@query(_gaps_sql(q.shipments(["l_suppkey"]), "GROUP BY l_suppkey"))
def gate_gaps_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_suppkey"]
    return quality.gap_report(shipments(spark, sf_dir, keys), keys=keys, folded=True)


@query(
    """
    SELECT count(*) AS rows,
           count(*) FILTER (WHERE o_orderdate::DATE > first_shipment) AS inverted
    FROM orders JOIN (SELECT l_orderkey, min(l_shipdate::DATE) AS first_shipment
                      FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""
)
def gate_interval_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose first shipment precedes them. Line items are folded to one row
    per order before the join, so a very long order joins like any other."""
    shipped = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_shipdate").cast("date").alias("first_shipment"))
    )
    ordered = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("ordered")
    )
    return quality.interval_report(
        ordered.join(shipped, "o_orderkey"), "ordered", "first_shipment"
    )


@query(
    """
    SELECT count(*) AS rows,
           count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup'))
             AS unknown_values
    FROM events"""
)
def gate_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.vocabulary_report(
        read(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase", "signup"]
    )


@query(
    """
    SELECT count(*) AS rows, count(*) > 0 AS non_empty, count(*) >= 10000 AS maybe_truncated
    FROM events"""
)
def gate_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.size_report(read(spark, sf_dir, "events"), cap=10_000)


# Raw orders as they come, not one row per day: days repeat and are missing, and a week has none.
RAW_DAYS = """
    SELECT o_orderpriority, CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE o_orderdate::DATE END AS day,
           CASE WHEN o_custkey % 31 = 0 THEN NULL ELSE o_totalprice END AS amount
    FROM orders WHERE NOT o_orderdate::DATE BETWEEN DATE '1997-03-03' AND DATE '1997-03-09'"""


def raw_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    lost = F.col("day").between(F.lit(date(1997, 3, 3)), F.lit(date(1997, 3, 9)))
    return orders.filter(~lost).select(
        "o_orderpriority",
        F.when(F.col("o_custkey") % 97 != 0, F.col("day")).alias("day"),
        F.when(F.col("o_custkey") % 31 != 0, F.col("o_totalprice")).alias("amount"),
    )


@query(
    f"""
    SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(lacking) AS BIGINT) AS null_rows,
           CAST(sum(n - kinds) AS BIGINT) AS duplicate_rows,
           count(*) FILTER (WHERE days <> d) AS series_with_gaps,
           min(first) AS first_day, max(last) AS last_day
    FROM (SELECT count(*) AS n, count(DISTINCT day) AS days, max(day) - min(day) + 1 AS d,
                 count(DISTINCT coalesce(day, DATE '0001-01-01')) AS kinds,
                 count(*) FILTER (WHERE day IS NULL OR amount IS NULL) AS lacking,
                 min(day) AS first, max(day) AS last
          FROM ({RAW_DAYS}) GROUP BY o_orderpriority)"""
)
def gate_series_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same checks on rows that repeat days, miss some and lack values."""
    keys = ["o_orderpriority"]
    return quality.series_report(raw_days(spark, sf_dir), keys=keys, required=["day", "amount"])


FAULTY_WINDOWS = """
    SELECT CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE o_orderdate::DATE END AS start_day,
           o_orderdate::DATE + CAST(o_custkey % 9 AS INTEGER) - 2 AS end_day, o_orderpriority AS kind,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS source
    FROM orders"""


@query(
    f"""
    SELECT count(*) AS rows,
           count(*) FILTER (WHERE start_day IS NULL OR end_day IS NULL OR kind IS NULL OR source IS NULL)
             AS null_rows,
           count(*) FILTER (WHERE start_day > end_day) AS inverted,
           count(*) FILTER (WHERE kind NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS unknown_values,
           count(*) - count(DISTINCT (coalesce(start_day, DATE '0001-01-01'), kind)) AS duplicate_rows
    FROM ({FAULTY_WINDOWS})"""
)
def gate_calendar_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar's checks on windows that end too early, repeat and lack values."""
    start = F.col("o_orderdate").cast("date")
    windows = read(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 13 != 0, start).alias("start_day"),
        F.date_add(start, (F.col("o_custkey") % 9 - 2).cast("int")).alias("end_day"),
        F.col("o_orderpriority").alias("kind"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("source"),
    )
    return quality.calendar_report(
        windows, ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["start_day", "end_day", "kind", "source"]
    )


@query(
    f"""
    SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_rows,
           CAST(0 AS BIGINT) AS duplicate_rows,
           count(*) FILTER (WHERE n <> d) AS series_with_gaps,
           min(first) AS first_day, max(last) AS last_day
    FROM (SELECT count(*) AS n, max(day) - min(day) + 1 AS d, min(day) AS first,
                 max(day) AS last
          FROM ({q.sales(['o_orderpriority'])}) GROUP BY o_orderpriority)"""
)
def gate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of a daily series in one pass."""
    keys = ["o_orderpriority"]
    return quality.series_report(sales(spark, sf_dir, keys), keys=keys)


@query(
    f"""
    SELECT count(*) AS rows, CAST(0 AS BIGINT) AS null_rows,
           count(*) FILTER (WHERE start_day > end_day) AS inverted,
           count(*) FILTER (WHERE kind NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))
             AS unknown_values,
           count(*) - count(DISTINCT (start_day, kind)) AS duplicate_rows
    FROM ({WINDOWS})"""
)
def gate_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of a window calendar in one pass, against too small a vocabulary."""
    return quality.calendar_report(
        campaign_windows(spark, sf_dir),
        ["1-URGENT", "2-HIGH", "3-MEDIUM"],
        ["start_day", "end_day", "kind", "source"],
    )


@query(
    f"""
    SELECT (SELECT count(*) FROM ({q.shipments(['l_returnflag'])})) AS source_rows,
           count(*) AS view_rows,
           count(*) FILTER (WHERE base_weeks < 4) AS incomplete_bases,
           count(*) FILTER (WHERE base_weeks = 4 AND quantity_pct IS NULL) AS unexpected_nulls
    FROM ({q.baseline(q.shipments(['l_returnflag']), ['l_returnflag'])})"""
)
def baseline_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag"]
    source = shipments(spark, sf_dir, keys)
    view = rolling_weekday_baseline(source, METRICS, keys)
    return quality.baseline_integrity(source, view, "quantity")


def _lag_integrity_sql(days: int, source: str) -> str:
    return f"""
    SELECT (SELECT count(*) FROM ({source})) AS source_rows, count(*) AS view_rows,
           count(*) FILTER (WHERE previous_day IS NULL) AS without_partner,
           count(*) FILTER (WHERE previous_day IS NOT NULL
                              AND dayofweek(day) <> dayofweek(previous_day))
             AS weekday_mismatches
    FROM ({q.yearly(source, days=days)})"""


@query(_lag_integrity_sql(364, q.shipments()))
def yoy_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = shipments(spark, sf_dir)
    return quality.lag_integrity(source, lag_variation(source, METRICS))


@query(_lag_integrity_sql(365, q.sales()))
def same_date_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """365 days shift the weekday: every pair is a mismatch."""
    source = sales(spark, sf_dir)
    return quality.lag_integrity(source, lag_variation(source, METRICS, days=365))


@query(
    """
    SELECT count(*) AS rows, min(l_shipdate::DATE) AS first_day, max(l_shipdate::DATE) AS last_day,
           count(*) - count(DISTINCT l_shipdate::DATE) AS duplicates
    FROM lineitem"""
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    return quality.table_profile(rows)
