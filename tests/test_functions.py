from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import (
    cents_sum,
    count_where,
    days_to_month_end,
    is_weekend,
    iso_weekday,
    mean_as,
    money_sum,
    month_slot,
    pct_change,
    share_of_counts,
    share_where,
    span_days,
    week_start,
    weekday_label,
)
from tideline.functions.dates import WEEKDAYS_PT

relaxed = settings(
    max_examples=15, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_calendar_expressions(spark):
    days = [date(2024, 1, 1), date(2024, 1, 7), date(2024, 2, 29), date(2026, 9, 26)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select(
        "d",
        iso_weekday("d").alias("w"),
        weekday_label(iso_weekday("d"), WEEKDAYS_PT).alias("n"),
        is_weekend(iso_weekday("d")).alias("e"),
        week_start("d").cast("date").alias("s"),
        days_to_month_end("d").alias("m"),
        month_slot("d").alias("slot"),
    )
    for r in rows.collect():
        assert r.w == r.d.isoweekday()
        assert r.n == WEEKDAYS_PT[r.d.isoweekday() - 1]
        assert r.e == (r.d.isoweekday() >= 6)
        assert r.s.isoweekday() == 1 and 0 <= (r.d - r.s).days < 7
        assert r.slot == (r.d.day - 1) // 7 + 1
    assert [r.m for r in rows.collect()] == [30, 24, 0, 4]


def test_labels_need_seven_names():
    with pytest.raises(ValueError):
        weekday_label("w", ["a", "b"])


def test_span_counts_both_ends(spark):
    a, b = F.lit(date(2024, 2, 28)), F.lit(date(2024, 3, 1))
    assert one(spark, n=span_days(a, b)).n == 3


# Published percentages: quantity, mean of the base, percentage.
GOLDEN = [
    (147134548, "172216851.25", "-14.56"),
    (172254730, "202202815.25", "-14.81"),
    (129748340, "146289390.00", "-11.31"),
    (160243695, "194259745.25", "-17.51"),
    (124810434, "142725950.75", "-12.55"),
    (121863613, "136587656.50", "-10.78"),
    (174080945, "195574491.25", "-10.99"),
    (199193756, "251905316.25", "-20.93"),
    (157542812, "184002242.00", "-14.38"),
    (189246741, "238793793.00", "-20.75"),
    (153429683, "178553575.50", "-14.07"),
]


def test_published_percentages(spark):
    rows = [(q, Decimal(m), Decimal(p)) for q, m, p in GOLDEN]
    df = spark.createDataFrame(rows, "q bigint, m decimal(18,2), p decimal(10,2)")
    assert df.filter(pct_change(F.col("q"), F.col("m")) != F.col("p")).count() == 0


@pytest.mark.parametrize(
    "hits,total,expected",
    [(6, 104, "5.8"), (3, 104, "2.9"), (2, 52, "3.8"), (0, 7, "0.0"), (7, 52, "13.5")],
)
def test_published_shares(spark, hits, total, expected):
    counted = one(spark, s=share_of_counts(F.lit(hits), F.lit(total))).s
    averaged = spark.range(total).agg(share_where(F.col("id") < hits).alias("s")).first().s
    assert counted == averaged == Decimal(expected)


def test_share_passes_through_five_places(spark):
    # 1 of 2010 is 0.0004975: 0.00050 at five places, 0.1 percent in the end.
    hits, total = 1, 2010
    averaged = spark.range(total).agg(share_where(F.col("id") < hits).alias("s")).first().s
    assert one(spark, s=share_of_counts(F.lit(hits), F.lit(total))).s == averaged == Decimal("0.1")


def test_share_ignores_rows_outside(spark):
    df = spark.createDataFrame([(1, True), (9, True), (1, False)], "x int, inside boolean")
    row = df.agg(
        share_where(F.col("x") <= 1, F.col("inside")).alias("some"),
        share_where(F.col("x") <= 1, F.lit(False)).alias("none"),
        count_where(F.col("x") <= 1).alias("n"),
    ).first()
    assert (row.some, row.none, row.n) == (Decimal("50.0"), None, 2)


def test_null_condition_is_not_met(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert df.agg(share_where(F.col("x") <= 1).alias("s")).first().s == Decimal("50.0")


def test_zero_base(spark):
    zero = F.lit(Decimal("0.00")).cast("decimal(18,2)")
    assert one(spark, p=pct_change(F.lit(5), zero, on_zero="null")).p is None
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        df = spark.createDataFrame([(5, 0)], "x bigint, b bigint")
        df.select(pct_change(F.col("x"), F.col("b"))).collect()
    with pytest.raises(ValueError):
        pct_change(F.lit(1), F.lit(1), on_zero="ignore")


def test_half_cent_means_round_up(spark):
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "x decimal(18,2)")
    assert df.agg(mean_as("x").alias("m")).first().m == Decimal("0.02")


@relaxed
@given(
    st.lists(
        st.one_of(
            st.none(),
            st.integers(-(10**9), 10**9).map(lambda c: c / 100),
            st.floats(-1e7, 1e7, allow_nan=False),
            st.sampled_from([1.005, 2.675, 0.125, -1.005, 1234567.895, 1e13 + 0.5]),
        ),
        max_size=40,
    )
)
def test_cents_sum_equals_the_decimal_sum(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = df.agg(cents_sum("x").alias("a"), money_sum("x").alias("b")).first()
    assert row.a == row.b
