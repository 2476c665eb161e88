from collections import defaultdict
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.operators.series import densify, latest_days, with_calendar
from tideline.operators.variation import (
    both_variations,
    lag_variation,
    period_total,
    rolling_weekday_baseline,
    variation_vs_recent,
)

relaxed = settings(
    max_examples=12, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
CENT = Decimal("0.01")


def half_up(x):
    return x.quantize(CENT, ROUND_HALF_UP)


def collect(df, *columns):
    return {r["day"]: tuple(r[c] for c in columns) for r in df.collect()}


def model_baseline(rows, weeks, frame):
    """rows: sorted (day, value or None) -> day: (mean, pct, n)"""
    out = {}
    for day, value in rows:
        same = [(d, v) for d, v in rows if d < day and d.weekday() == day.weekday()]
        if frame == "rows":
            base = same[-weeks:]
        else:
            base = [(d, v) for d, v in same if (day - d).days <= 7 * weeks]
        known = [Decimal(v) for _, v in base if v is not None]
        mean = half_up(sum(known) / len(known)) if known else None
        pct = None
        if len(base) == weeks and mean is not None and value is not None:
            pct = half_up((Decimal(value) - mean) / mean * 100)
        out[day] = (mean, pct, len(base))
    return out


@relaxed
@given(
    values=st.lists(st.one_of(st.none(), st.integers(1, 500)), min_size=1, max_size=70),
    gaps=st.sets(st.integers(0, 69), max_size=15),
    weeks=st.integers(1, 5),
    frame=st.sampled_from(["rows", "calendar"]),
)
def test_baseline_matches_a_plain_model(series, values, gaps, weeks, frame):
    df = series(values, gaps=gaps)
    got = collect(
        rolling_weekday_baseline(df, ["x"], weeks=weeks, frame=frame),
        "x_mean", "x_pct", "base_weeks",
    )
    first = date(2024, 1, 1)
    rows = [(first + timedelta(days=i), v) for i, v in enumerate(values) if i not in gaps]
    assert got == model_baseline(rows, weeks, frame)


@relaxed
@given(
    values=st.lists(st.one_of(st.none(), st.integers(1, 500)), min_size=1, max_size=60),
    gaps=st.sets(st.integers(0, 59), max_size=15),
    days=st.sampled_from([1, 7, 14, 28, 30]),
)
def test_lag_matches_a_plain_model(series, values, gaps, days):
    df = series(values, gaps=gaps, kind="decimal(18,2)")
    got = collect(lag_variation(df, ["x"], days=days), "previous_day", "x_previous", "x_yoy_pct")
    first = date(2024, 1, 1)
    rows = {first + timedelta(days=i): v for i, v in enumerate(values) if i not in gaps}
    want = {}
    for day, value in rows.items():
        before = day - timedelta(days=days)
        if before not in rows:
            want[day] = (None, None, None)
            continue
        base = rows[before]
        pct = None
        if base is not None and value is not None:
            pct = half_up((Decimal(value) - base) / base * 100)
        want[day] = (before, None if base is None else Decimal(base).quantize(CENT), pct)
    assert got == want


def test_means_are_filled_before_the_base_is_complete(series):
    got = collect(rolling_weekday_baseline(series(range(1, 36)), ["x"]), "x_mean", "x_pct")
    assert got[date(2024, 1, 1)] == (None, None)
    assert got[date(2024, 1, 8)] == (Decimal("1.00"), None)
    assert got[date(2024, 1, 29)] == (Decimal("11.50"), Decimal("152.17"))


def test_null_counts_for_completeness_but_not_for_the_mean(series):
    values = [10] * 35
    values[7] = None
    row = rolling_weekday_baseline(series(values), ["x"]).filter("day = '2024-01-29'").first()
    assert (row.x_mean, row.x_pct, row.base_weeks) == (Decimal("10.00"), Decimal("0.00"), 4)


def test_percentage_uses_the_rounded_mean(series):
    # The base averages 2.375 cents of a unit: the mean is 0.02, not 0.02375.
    values = [0] * 35
    for i, v in zip((0, 7, 14, 21, 28), ("0.02", "0.02", "0.02", "0.03", "0.03")):
        values[i] = v
    df = series(values, kind="decimal(18,2)")
    row = (
        rolling_weekday_baseline(df, ["x"], on_zero="null").filter("day = '2024-01-29'").first()
    )
    assert (row.x_mean, row.x_pct) == (Decimal("0.02"), Decimal("50.00"))


def test_zero_base_raises_or_is_null(series):
    df = series([0] * 35)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        rolling_weekday_baseline(df, ["x"]).collect()
    assert rolling_weekday_baseline(df, ["x"], on_zero="null").filter("x_pct is not null").count() == 0


def test_frames_differ_only_where_days_are_missing(series):
    whole, holed = series(range(1, 60)), series(range(1, 60), gaps={7, 21})
    columns = ("x_mean", "x_pct", "base_weeks")

    def both(df):
        return [
            collect(rolling_weekday_baseline(df, ["x"], frame=f), *columns)
            for f in ("rows", "calendar")
        ]

    assert both(whole)[0] == both(whole)[1]
    rows, calendar = both(holed)
    differing = [d for d in rows if rows[d] != calendar[d]]
    assert differing and all(d.weekday() == 0 for d in differing)


def test_only_restricts_the_result_without_changing_it(series):
    df = series(range(1, 90), gaps={30, 31})
    only = (date(2024, 3, 4), date(2024, 3, 10))
    for options in ({"frame": "calendar"}, {"frame": "rows"}):
        full = rolling_weekday_baseline(df, ["x"], **options)
        part = rolling_weekday_baseline(df, ["x"], only=only, **options)
        want = full.filter(F.col("day").between(*only)).collect()
        assert sorted(part.collect()) == sorted(want)
    full = lag_variation(df, ["x"], days=28).filter(F.col("day").between(*only))
    part = lag_variation(df, ["x"], days=28, only=only)
    assert sorted(part.collect()) == sorted(full.collect())


def test_keys_are_independent(series):
    both = series(range(1, 60)).withColumn("k", F.lit("a")).union(
        series(range(100, 160)).withColumn("k", F.lit("b"))
    )
    keyed = lag_variation(rolling_weekday_baseline(both, ["x"], ["k"]), ["x"], ["k"], days=7)
    alone = lag_variation(
        rolling_weekday_baseline(series(range(100, 160)), ["x"]), ["x"], days=7
    )
    assert sorted(keyed.filter("k = 'b'").drop("k").collect()) == sorted(alone.collect())


def test_recent_mean_needs_no_complete_base_and_skips_nulls(series):
    values = [None] * 7 + [10] * 7 + [13] * 7
    df = series(values, kind="decimal(10,2)")
    got = collect(variation_vs_recent(df, "x"), "x_recent_mean", "x_gap_pp")
    assert got[date(2024, 1, 8)] == (None, None)
    assert got[date(2024, 1, 15)] == (Decimal("10.00"), Decimal("3.00"))


def test_gap_uses_the_unrounded_mean(series):
    values = [0] * 22
    for i, v in zip((0, 7, 14, 21), ("0.01", "0.00", "0.00", "0.01")):
        values[i] = v
    df = series(values, kind="decimal(10,2)")
    row = variation_vs_recent(df, "x").filter("day = '2024-01-22'").first()
    # Mean 0.003333: 0.01 - 0.003333 = 0.006667 rounds to 0.01; the rounded mean is 0.00.
    assert (row.x_recent_mean, row.x_gap_pp) == (Decimal("0.00"), Decimal("0.01"))


def test_period_total(series):
    based = rolling_weekday_baseline(series(range(1, 50)), ["x"])
    whole = period_total(based, ["x"], (date(2024, 2, 1), date(2024, 2, 3))).first()
    days = based.filter("day between '2024-02-01' and '2024-02-03'").collect()
    assert whole.x_total == sum(r.x for r in days)
    assert whole.x_base_total == sum(r.x_mean for r in days)
    early = period_total(based, ["x"], (date(2024, 1, 7), date(2024, 1, 8))).first()
    assert (early.days, early.x_base_total, early.x_total_pct) == (2, None, None)


def test_calendar_columns(series):
    row = with_calendar(series([5]), labels=list("abcdefg")).first()
    assert (row.year, row.month, row.day_of_month, row.weekday) == (2024, 1, 1, 1)
    assert (row.weekday_name, row.weekend) == ("a", False)


@relaxed
@given(gaps=st.sets(st.integers(0, 19), max_size=18), wide=st.booleans())
def test_densify_fills_exactly_the_missing_days(series, gaps, wide):
    first = date(2024, 1, 1)
    df = series(range(1, 21), gaps=gaps)
    span = {"start": first - timedelta(days=3), "end": first + timedelta(days=25)} if wide else {}
    got = densify(df, fill={"x": 0}, **span).collect()
    present = {first + timedelta(days=i): i + 1 for i in range(20) if i not in gaps}
    low, high = (span["start"], span["end"]) if wide else (min(present), max(present))
    want = {}
    day = low
    while day <= high:
        want[day] = (present.get(day, 0), day not in present)
        day += timedelta(days=1)
    assert {r.day: (r.x, r.inserted) for r in got} == want and len(got) == len(want)


def test_densify_per_key_keeps_own_span(series):
    a = series(range(1, 11), gaps={3}).withColumn("k", F.lit("a"))
    b = series(range(1, 6), first=date(2024, 3, 1), gaps={1, 2}).withColumn("k", F.lit("b"))
    filled = densify(a.union(b), keys=["k"])
    counts = defaultdict(int)
    for r in filled.collect():
        counts[r.k, r.inserted] += 1
        assert (r.x is None) == r.inserted
    assert counts == {("a", False): 9, ("a", True): 1, ("b", False): 3, ("b", True): 2}


def test_latest_days(series):
    newest = latest_days(series(range(20)), 3).collect()
    assert [r.x for r in newest] == [19, 18, 17]


def test_densify_covers_the_period_for_every_series(spark):
    rows = [("a", date(2024, 1, 2)), ("a", date(2024, 1, 2)), ("b", date(2020, 5, 5)), ("c", date(2030, 1, 1))]
    df = spark.createDataFrame([(k, d, 1) for k, d in rows], "k string, day date, x int")
    out = densify(df, keys=["k"], start=date(2024, 1, 1), end=date(2024, 1, 3)).collect()
    assert sorted((r.k, r.day.day, r.inserted) for r in out) == [
        ("a", 1, True), ("a", 2, False), ("a", 2, False), ("a", 3, True),
        *[(k, d, True) for k in "bc" for d in (1, 2, 3)],
    ]


def test_look_back_is_proven_or_refused(series, spark):
    from tideline.operators.variation import look_back

    period = (date(2024, 7, 1), date(2024, 7, 3))
    whole = series(range(400))
    assert look_back(whole, period) == date(2024, 6, 3)
    # One missing same weekday: the frame reaches a week further, so a longer cut is proven.
    holed = series(range(400), gaps=(180,))
    assert holed.filter("day = '2024-06-29'").isEmpty() and look_back(holed, (date(2024, 7, 6),) * 2) == date(2024, 3, 16)
    # The series starts too late for any cut to be full.
    assert look_back(series(range(200)), (date(2024, 1, 20), date(2024, 1, 21))) is None
    keyed = whole.withColumn("k", F.lit("a")).union(holed.withColumn("k", F.lit("b")))
    assert look_back(keyed, (date(2024, 7, 6),) * 2, ["k"]) == date(2024, 3, 16)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 500), max_size=120), st.integers(0, 480), st.integers(0, 40))
def test_pruned_results_are_those_of_the_whole_series(series, gaps, at, length):
    df = series([i * 7 % 101 + 1 for i in range(520)], gaps=gaps)
    period = (date(2024, 1, 1) + timedelta(days=at), date(2024, 1, 1) + timedelta(days=at + length))
    inside = F.col("day").between(*map(F.lit, period))
    rows = lambda frame: sorted(map(str, frame.collect()))
    want = lag_variation(rolling_weekday_baseline(df, ["x"]), ["x"]).filter(inside)
    assert rows(both_variations(df, ["x"], only=period)) == rows(want)
    pruned = rolling_weekday_baseline(df, ["x"], only=period, prove=True)
    assert rows(pruned) == rows(rolling_weekday_baseline(df, ["x"]).filter(inside))
