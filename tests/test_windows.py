from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tideline.operators.windows import (
    expand_windows,
    flag_windows,
    merge_windows,
    window_profile,
)

SCHEMA = "start_day date, end_day date, kind string"
FIRST = date(2024, 1, 1)


def at(n):
    return FIRST + timedelta(days=n)


@settings(
    max_examples=15, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12), st.sampled_from("abc")), max_size=15)
)
def test_expansion_is_the_set_of_covered_days(spark, windows):
    calendar = spark.createDataFrame([(at(s), at(s + n), k) for s, n, k in windows], SCHEMA)
    covered = {at(d) for s, n, k in windows if k == "a" for d in range(s, s + n + 1)}
    days = [r.day for r in expand_windows(calendar, "a").collect()]
    assert len(days) == len(set(days)) and set(days) == covered

    clipped = [r.day for r in expand_windows(calendar, "a", (at(5), at(20))).collect()]
    assert sorted(clipped) == sorted(d for d in covered if at(5) <= d <= at(20))

    merged = sorted(
        (r.start_day, r.end_day) for r in merge_windows(calendar.filter("kind = 'a'")).collect()
    )
    assert all(a[1] + timedelta(days=1) < b[0] for a, b in zip(merged, merged[1:]))


def test_reversed_window_stops_the_expansion(spark):
    calendar = spark.createDataFrame([(at(3), at(1), "a"), (at(3), at(9), "a")], SCHEMA)
    with pytest.raises(Exception, match="window ends before it starts"):
        expand_windows(calendar).collect()


def test_overlaps_flag_each_day_once(spark, series):
    calendar = spark.createDataFrame(
        [(at(2), at(4), "a"), (at(3), at(6), "a"), (at(8), at(8), "b")], SCHEMA
    )
    df = series(range(10))
    flagged = flag_windows(df, calendar, "a", "inside").collect()
    assert len(flagged) == 10
    assert {r.x for r in flagged if r.inside} == {2, 3, 4, 5, 6}


def test_windows_far_from_the_others_flag_their_days(spark):
    calendar = spark.createDataFrame(
        [(date(1200, 1, 1), date(1200, 1, 2), "a"), (date(2101, 3, 1), date(2101, 3, 3), "a")], SCHEMA
    )
    days = [date(1200, 1, 2), date(2024, 1, 1), date(2101, 3, 3)]
    frame = spark.createDataFrame([(d,) for d in days], "day date")
    flagged = flag_windows(frame, calendar, "a", "inside").orderBy("day").collect()
    assert [r.inside for r in flagged] == [True, False, True]


def test_profile(spark):
    calendar = spark.createDataFrame([(at(2), at(4), "a"), (at(0), at(9), "a")], SCHEMA)
    row = window_profile(calendar).first()
    assert (row.kind, row.windows, row.first_day, row.last_day) == ("a", 2, at(0), at(9))
