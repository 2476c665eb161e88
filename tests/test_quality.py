from datetime import date

import pytest
from pyspark.sql import functions as F

from tideline.operators import quality as g
from tideline.operators.series import daily_series
from tideline.operators.variation import lag_variation, rolling_weekday_baseline

CALENDAR = "start_day date, end_day date, kind string, source string"


def windows(spark, *rows):
    return spark.createDataFrame(list(rows), CALENDAR)


GOOD = (date(2024, 1, 1), date(2024, 1, 5), "cup", "u")


def calendar_gate(df):
    return g.require(
        g.calendar_report(df, ["cup", "break"], ["start_day", "end_day", "kind", "source"])
    )


def test_series_passes(series):
    row = g.require(g.series_report(series(range(10))))
    assert (row.rows, row.first_day, row.last_day) == (10, date(2024, 1, 1), date(2024, 1, 10))


def test_series_with_a_gap_fails(series):
    report = g.series_report(series(range(10), gaps={4}))
    with pytest.raises(g.GateError, match="miss days"):
        g.require(report)
    assert g.require(report, allow=["series_with_gaps"]).rows == 9


def test_series_with_a_repeated_day_fails(series):
    df = series(range(3)).union(series(range(1)))
    with pytest.raises(g.GateError, match="repeat a key"):
        g.require(g.series_report(df))


def test_series_with_a_null_day_fails(series, spark):
    df = series(range(3)).union(spark.createDataFrame([(None, 1)], "day date, x bigint"))
    with pytest.raises(g.GateError, match="lack a required value"):
        g.require(g.series_report(df))


def test_empty_batch_fails(series):
    for df in (series([1]).limit(0), series([1]).withColumn("k", F.lit(1)).limit(0)):
        with pytest.raises(g.GateError, match="empty"):
            g.require(g.series_report(df, keys=["k"] if "k" in df.columns else []))


def test_series_per_key(series):
    a = series(range(5)).withColumn("k", F.lit("a"))
    b = series(range(5), gaps={2}).withColumn("k", F.lit("b"))
    row = g.series_report(a.union(b), keys=["k"]).first()
    assert (row.rows, row.duplicate_rows, row.series_with_gaps) == (9, 0, 1)
    gaps = g.gap_report(a.union(b), keys=["k"]).first()
    assert (gaps.series, gaps.days_in_span, gaps.series_with_gaps, gaps.contiguous) == (2, 10, 1, False)


def test_calendar_passes(spark):
    assert calendar_gate(windows(spark, GOOD)).rows == 1


@pytest.mark.parametrize(
    "bad,message",
    [
        ((date(2024, 2, 2), date(2024, 2, 1), "cup", "u"), "end before"),
        ((date(2024, 2, 1), date(2024, 2, 1), "cupp", "u"), "vocabulary"),
        ((date(2024, 2, 1), date(2024, 2, 1), "cup", None), "lack a required value"),
        ((date(2024, 2, 1), None, "cup", "u"), "lack a required value"),
        (GOOD, "repeat a key"),
    ],
)
def test_calendar_failures(spark, bad, message):
    with pytest.raises(g.GateError, match=message):
        calendar_gate(windows(spark, GOOD, bad))


def test_empty_calendar_fails(spark):
    with pytest.raises(g.GateError, match="empty"):
        calendar_gate(windows(spark, GOOD).limit(0))


def test_null_kind_is_not_unknown(spark):
    df = windows(spark, (date(2024, 2, 1), date(2024, 2, 1), None, "u"))
    row = g.calendar_report(df, ["cup"], ["kind"]).first()
    assert (row.null_rows, row.unknown_values) == (1, 0)
    assert g.vocabulary_report(df, "kind", ["cup"]).first().unknown_values == 0


def test_duplicates_count_null_as_a_key_and_profile_does_not(spark):
    df = spark.createDataFrame([(None,), (None,), (date(2024, 1, 1),)], "day date")
    row = g.duplicate_report(df, ["day"]).first()
    assert (row.rows, row.distinct_keys, row.repeated_keys, row.duplicate_rows) == (3, 2, 1, 1)
    assert g.table_profile(df).first().duplicates == 2


def test_small_reports(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (None, 1)], "a int, b int")
    assert g.interval_report(df, "a", "b").first().inverted == 1
    nulls = g.null_report(df, ["a", "b"]).first()
    assert (nulls.rows, nulls.null_rows, nulls.null_a, nulls.null_b) == (3, 1, 1, 0)
    size = g.size_report(df, cap=3).first()
    assert (size.rows, size.non_empty, size.maybe_truncated) == (3, True, True)
    assert g.size_report(df.limit(0), cap=3).first().non_empty is False


def test_view_integrity(series):
    df = series(range(1, 400))
    weekly = rolling_weekday_baseline(df, ["x"])
    row = g.baseline_integrity(df, weekly, "x").first()
    assert (row.source_rows, row.view_rows, row.incomplete_bases, row.unexpected_nulls) == (
        399, 399, 28, 0,
    )
    row = g.lag_integrity(df, lag_variation(df, ["x"])).first()
    assert (row.without_partner, row.weekday_mismatches) == (364, 0)
    shifted = g.lag_integrity(df, lag_variation(df, ["x"], days=365)).first()
    assert (shifted.without_partner, shifted.weekday_mismatches) == (365, 34)


def test_unexpected_nulls_are_seen(series):
    values = [1] * 35
    values[28] = None
    weekly = rolling_weekday_baseline(series(values), ["x"])
    assert g.baseline_integrity(series(values), weekly, "x").first().unexpected_nulls == 1


def test_a_repeated_day_does_not_hide_a_gap(spark):
    df = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 1, 3)], "day date")
    found = g.gap_report(df).first()
    assert (found.rows, found.days_in_span, found.series_with_gaps, found.contiguous) == (3, 3, 1, False)
    assert g.series_report(df).first().series_with_gaps == 1


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_gaps_of_a_roll_up_need_no_second_fold(spark, keys):
    """Rows repeat, days are missing or NULL, and one key is NULL."""
    days = {"a": (1, 1, 2, 3), "b": (1, 3, 3, 3), "c": (4, None, None), "d": (None,), None: (1, 2, 5)}
    facts = [(k, d and date(2024, 1, d)) for k, each in days.items() for d in each]
    df = spark.createDataFrame(facts, "k string, at date")
    for source in (df, df.limit(0)):
        daily = daily_series(source, "at", {"n": F.count(F.lit(1))}, keys)
        once, again = (g.gap_report(daily, keys=keys, folded=x).first() for x in (True, False))
        assert once == again
        if source is df:
            wanted = (5, 11, 12, 2, False) if keys else (1, 6, 5, 0, True)
            assert tuple(once) == wanted
