from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tideline.operators.adjusted import (
    before_after,
    cycle_profile,
    inside_outside,
    trend_deviation,
    with_business_days,
    with_month_cycle,
)

D = Decimal


def test_business_days(spark, series):
    holidays = spark.createDataFrame(
        [(date(2024, 1, 1),), (date(2024, 1, 1),), (date(2024, 1, 6),)], "day date"
    )
    df = series(range(40))
    rows = {r.day: r for r in with_business_days(df, holidays).collect()}
    assert len(rows) == 40
    assert not rows[date(2024, 1, 1)].business_day
    assert rows[date(2024, 1, 2)].business_day_number == 1
    assert rows[date(2024, 1, 6)].holiday and rows[date(2024, 1, 6)].business_day_number is None
    assert rows[date(2024, 1, 31)].business_day_number == 22
    assert rows[date(2024, 1, 31)].business_days_in_month == 22
    assert rows[date(2024, 2, 1)].business_day_number == 1


def test_month_cycle(series):
    rows = {r.day.day: r for r in with_month_cycle(series(range(31)), pay_days=(5,)).collect()}
    assert [rows[d].month_phase for d in (1, 5, 6, 26, 27, 31)] == [
        "start", "start", "middle", "middle", "end", "end",
    ]
    assert rows[5].pay_day and not rows[6].pay_day
    assert (rows[31].days_to_month_end, rows[31].month_slot) == (0, 5)


def test_cycle_profile(series):
    rows = cycle_profile(series([4] * 31), ["x"]).collect()
    assert sum(r.days for r in rows) == 31 and {r.x_mean for r in rows} == {D("4.00")}


def test_trend_on_a_straight_line(series):
    df = series([10 + 2 * i for i in range(60)])
    fit = (date(2024, 1, 1), date(2024, 1, 31))
    for by_weekday in (True, False):
        rows = trend_deviation(df, "x", fit, by_weekday=by_weekday).collect()
        assert {r.trend_slope for r in rows} == {2.0}
        assert {r.trend_pct for r in rows} == {D("0.00")}
    late = trend_deviation(df.withColumn("x", F.expr("if(day = '2024-02-20', 55, x)")), "x", fit)
    assert late.filter("day = '2024-02-20'").first().trend_pct == D("-50.00")


def test_trend_needs_two_days(series):
    fit = (date(2024, 1, 1), date(2024, 1, 1))
    row = trend_deviation(series([5, 6]), "x", fit).first()
    assert (row.trend_slope, row.trend_expected, row.trend_pct) == (None, None, None)


def test_before_after(series):
    values = [10] * 10 + [5] * 10
    marker = date(2024, 1, 1) + timedelta(days=9)
    rows = before_after(series(values), ["x"], {"m": marker, "far": date(2030, 1, 1)}, 7, 3)
    row, = rows.collect()
    assert (row.marker, row.days_before, row.days_after) == ("m", 7, 3)
    assert (row.x_before, row.x_after, row.x_change_pct) == (D("10.00"), D("5.00"), D("-50.00"))


def test_near_markers_share_days(series):
    markers = {"a": date(2024, 1, 10), "b": date(2024, 1, 12)}
    rows = before_after(series(range(1, 31)), ["x"], markers, 5, 5).collect()
    assert {r.marker: (r.days_before, r.days_after) for r in rows} == {"a": (5, 5), "b": (5, 5)}


def test_adjustment_removes_the_weekday_mix(series):
    # Weekends run at half volume; the flagged days are all weekend days.
    values = [50 if i % 7 >= 5 else 100 for i in range(56)]
    df = series(values).withColumn("event", F.expr("weekday(day) >= 5 and day >= '2024-02-12'"))
    row = inside_outside(df, "x", "event").first()
    assert row.days_inside == 4 and row.naive_pct < D("-40")
    assert row.adjusted_pct == D("0.00")


def test_strata_without_comparison_take_no_part(series):
    df = series([10] * 14).withColumn("event", F.expr("weekday(day) = 0 or day = '2024-01-02'"))
    row = inside_outside(df, "x", "event").first()
    assert (row.days_inside, row.adjusted_pct) == (3, D("0.00"))


def test_holidays_as_a_condition(series, spark):
    df = series(range(70))
    free = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 2, 14),)], "day date")
    told = F.date_format("day", "MM-dd").isin("01-01", "02-14")
    by_table, by_condition = with_business_days(df, free), with_business_days(df, told)
    assert sorted(map(str, by_table.select(*by_condition.columns).collect())) == sorted(map(str, by_condition.collect()))
    assert "Join" not in by_condition._jdf.queryExecution().executedPlan().toString()


def test_trend_is_the_same_under_any_partitioning(spark):
    """Sums of doubles would depend on the order; the exact line is known."""
    rows = [(date(2020, 1, 1) + timedelta(days=i), D(i % 13) / 100 + D(10) ** (i % 9)) for i in range(900)]
    fit, x, y = (rows[50][0], rows[800][0]), [], []
    for d, v in rows[50:801]:
        x.append((d - fit[0]).days)
        y.append(v)
    n, sx, sy = len(x), sum(x), sum(y)
    sxx, sxy = sum(a * a for a in x), sum(a * b for a, b in zip(x, y))
    slope = (n * sxy - sx * sy) / D(n * sxx - sx * sx)
    df = spark.createDataFrame(rows, "day date, x decimal(18,2)")
    found = set()
    for parts in (1, 3, 8):
        out = trend_deviation(df.repartition(parts, F.rand(parts)), "x", fit, by_weekday=False, on_zero="null")
        found.add(tuple(sorted((r.day, r.trend_slope, r.trend_expected) for r in out.collect())))
    assert len(found) == 1
    [lines] = found
    assert all(abs(D(s) - slope) < D("0.000001") for _, s, _ in lines)
    start = (sy - slope * sx) / n
    assert all(abs(e - (start + slope * (d - fit[0]).days)) <= D("0.00501") for d, _, e in lines)


def test_trend_needs_two_days(series):
    df = series([5, None, None, 8, 9])
    one = trend_deviation(df, "x", (date(2024, 1, 1), date(2024, 1, 3)), by_weekday=False)
    assert {(r.trend_slope, r.trend_expected, r.trend_pct) for r in one.collect()} == {(None, None, None)}
