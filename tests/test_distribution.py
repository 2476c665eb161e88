import math
from datetime import date, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.operators.compare import inline, reconcile, side_by_side
from tideline.operators.distribution import (
    base_detail,
    distribution,
    exceedances,
    position_by_window,
    position_in_history,
    weekday_means,
    weekly_trend,
)

relaxed = settings(
    max_examples=12, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
D = Decimal
FIRST_DAY = date(2024, 1, 1)
PCT = "decimal(10,2)"


def test_distribution_with_and_without_unknown_days(series):
    df = series([-20, -10, None, 0, 10, 30], kind=PCT)
    known = distribution(df, "x", [F.year("day").alias("year")], count_low=True).first()
    assert (known.days, known.median_pct, known.p05_pct, known.p95_pct) == (
        5, D("0.00"), D("-18.00"), D("26.00"),
    )
    assert (known.pct_days_low, known.days_low, known.pct_days_high) == (D("40.0"), 2, D("40.0"))
    every = distribution(df, "x", [F.year("day").alias("year")], only_known=False).first()
    assert (every.days, every.median_pct) == (6, D("0.00"))
    assert (every.pct_days_low, every.pct_days_high) == (D("33.3"), D("33.3"))


def test_distribution_period_cap_and_keys(series):
    df = series(range(10), kind=PCT).withColumn("k", F.lit("a"))
    by = [F.year("day").alias("year")]
    assert distribution(df, "x", by, ["k"], through=date(2024, 1, 4)).first().days == 4
    period = (date(2024, 1, 2), date(2024, 1, 3))
    row = distribution(df, "x", by, ["k"], period=period, high=None).first()
    assert row.days == 2 and row.k == "a" and "pct_days_high" not in row


@relaxed
@given(st.lists(st.one_of(st.none(), st.decimals(-200, 200, places=2)), min_size=1, max_size=60), st.booleans())
def test_distribution_against_interpolation(spark, values, only_known):
    rows = [(i % 2, FIRST_DAY + timedelta(days=i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"g int, day date, x {PCT}").withColumn("g", F.when(F.col("g") == 1, 1))
    got = {r.g: r for r in distribution(df, "x", ["g"], count_low=True, only_known=only_known).collect()}
    for group, place in ((None, 0), (1, 1)):
        mine = [v for i, _, v in rows if i == place]
        known = sorted(v for v in mine if v is not None)
        counted = known if only_known else mine
        if not counted:
            assert group not in got
            continue
        row = got[group]
        assert row.days == len(counted) and row.days_low == sum(v <= -10 for v in known)
        share = lambda n: (100 * D(n) / D(len(counted)).quantize(D("1"))).quantize(D("0.1"), "ROUND_HALF_UP")
        assert (row.pct_days_low, row.pct_days_high) == (share(row.days_low), share(sum(v >= 10 for v in known)))
        for name, p in (("median_pct", 0.5), ("p05_pct", 0.05), ("p95_pct", 0.95)):
            if not known:
                assert row[name] is None
                continue
            at = (len(known) - 1) * p
            low, high = float(known[math.floor(at)]), float(known[math.ceil(at)])
            want = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
            assert abs(float(row[name]) - want) <= 0.00501


def test_percentiles_of_a_million_distinct_values_in_one_group(spark):
    days = spark.range(1_000_000).select(
        F.lit("one").alias("g"),
        F.lit(FIRST_DAY).alias("day"),
        ((F.pmod(F.col("id") * 7919, F.lit(1_000_000)) - 500_000) / 100).cast(PCT).alias("x"),
    )
    row = distribution(days, "x", ["g"]).first()
    # of -5000.00, -4999.99 ... 4999.99
    assert (row.days, row.median_pct) == (1_000_000, D("-0.01"))
    assert (row.p05_pct, row.p95_pct) == (D("-4500.00"), D("4499.99"))
    assert (row.pct_days_low, row.pct_days_high) == (D("49.9"), D("49.9"))


def pairs(rows, targets, windows):
    """Pair every target with its history: day -> [(days, share), ...]."""
    out = {}
    for day, value in rows:
        if not targets[0] <= day <= targets[1]:
            continue
        result, seen = [], False
        for low, high in windows:
            history = [
                v for d, v in rows if low <= d <= high and d.weekday() == day.weekday()
            ]
            seen |= bool(history)
            hits = sum(1 for v in history if v is not None and value is not None and v <= value)
            share = None
            if history:
                five = (D(hits) / len(history)).quantize(D("0.00001"), "ROUND_HALF_UP")
                share = (100 * five).quantize(D("0.1"), "ROUND_HALF_UP")
            result.append((len(history), share))
        if seen:
            out[day] = result
    return out


@relaxed
@given(
    st.lists(st.one_of(st.none(), st.integers(-4, 4)), min_size=5, max_size=70),
    st.integers(0, 69),
    st.integers(0, 69),
    st.integers(0, 69),
)
def test_position_equals_pairing(series, values, target, wide, narrow):
    first = date(2024, 1, 1)
    targets = (first + timedelta(days=target), first + timedelta(days=target + 9))
    # Windows may overlap the targets and each other.
    windows = {
        "a": (first + timedelta(days=min(wide, narrow)), first + timedelta(days=45)),
        "b": (first + timedelta(days=max(wide, narrow)), first + timedelta(days=45)),
    }
    df = series(values, kind=PCT)
    got = {
        r.day: [(r.days_a, r.pct_at_or_below_a), (r.days_b, r.pct_at_or_below_b)]
        for r in position_in_history(df, "x", targets, windows).collect()
    }
    rows = [(first + timedelta(days=i), v) for i, v in enumerate(values)]
    want = pairs(rows, targets, list(windows.values()))
    assert got == want

    by_row = {
        (r.day, r.window): (r.days, r.pct_at_or_below)
        for r in position_by_window(df, "x", targets, windows).collect()
    }
    expected = {
        (day, name): cell
        for day, cells in want.items()
        for name, cell in zip(windows, cells)
        if cell[0] > 0
    }
    assert by_row == expected


def test_position_counts_ties_and_ignores_unknown(series):
    # Mondays only: 3, 3, NULL, then the target 3.
    values = [None] * 22
    values[0] = values[7] = values[21] = 3
    df = series(values, kind=PCT)
    targets = (date(2024, 1, 22), date(2024, 1, 22))
    row = position_in_history(
        df, "x", targets, {"h": (date(2024, 1, 1), date(2024, 1, 21))}
    ).first()
    assert (row.days_h, row.pct_at_or_below_h) == (3, D("66.7"))


def test_position_with_narrowed_history(series):
    df = series(range(40), kind=PCT)
    targets = (date(2024, 2, 5), date(2024, 2, 5))
    window = {"h": (date(2024, 1, 1), date(2024, 2, 4))}
    kept = position_in_history(
        df, "x", targets, window, history=F.col("day") != F.lit(date(2024, 1, 8))
    ).first()
    assert kept.days_h == 4


def test_exceedances_and_base_detail(series):
    df = series([-12] * 14, kind=PCT)
    period = (date(2024, 1, 1), date(2024, 1, 10))
    assert [str(r.day) for r in exceedances(df, "x", -10, (6, 7), period).collect()] == [
        "2024-01-06", "2024-01-07",
    ]
    listed = base_detail(df, (6, 7, 1), period).collect()
    assert [(r.weekday, r.day.day) for r in listed] == [(1, 1), (1, 8), (6, 6), (7, 7)]


def test_weekly_trend_rounds_half_up(series):
    df = series(["0.01", "0.02", None, None, None, None, None, "0.05"], kind=PCT)
    rows = weekly_trend(df, ["x"]).orderBy("week_start").collect()
    assert [(str(r.week_start)[:10], r.days, r.x_mean) for r in rows] == [
        ("2024-01-01", 7, D("0.02")), ("2024-01-08", 1, D("0.05")),
    ]


def test_weekday_means(series):
    row = weekday_means(series(range(1, 15)), ["x"]).filter("weekday = 1").first()
    assert (row.days, row.x_mean) == (2, D("4.50"))


def test_reconcile_and_side_by_side(spark, series):
    df = series(range(5))
    published = inline(
        spark, [(date(2024, 1, 2), 7), (date(2024, 1, 4), None), (date(2030, 1, 1), 1)],
        "day date, told int",
    )
    rows = reconcile(df, published, ["day"]).orderBy("day").collect()
    assert [(r.x, r.told) for r in rows] == [(1, 7), (3, None)]
    joined = side_by_side(df, df.filter("x > 2").withColumnRenamed("x", "y"), ["day"])
    assert joined.count() == 2


def test_inline_of_many_and_of_no_rows(spark):
    assert sorted(r.x for r in inline(spark, [(i,) for i in range(1001)], "x int").collect()) == list(range(1001))
    empty = inline(spark, [], "x int, d date")
    assert empty.collect() == [] and empty.dtypes == [("x", "int"), ("d", "date")]


def test_ten_thousand_cuts_of_one_series(spark, series):
    """Rows out are targets times cuts; each cut equals plain counting."""
    values = [None if i % 17 == 0 else (i * 7919) % 211 for i in range(700)]
    df = series(values, kind=PCT, gaps=tuple(range(300, 320)))
    day = lambda i: FIRST_DAY + timedelta(days=i)
    cuts = {f"c{a}-{b}": (day(a), day(b)) for a in range(0, 500, 5) for b in range(500, 700, 2)}
    assert len(cuts) == 10_000
    targets = (day(690), day(691))
    found = position_by_window(df, "x", targets, cuts).collect()
    held = {r.day: r.x for r in df.collect()}
    alike = {t: sorted(d for d in held if d.weekday() == t.weekday()) for t in (day(690), day(691))}
    reached = sum(any(a <= d <= b for d in alike[t]) for t in alike for a, b in cuts.values())
    assert len(found) == reached > 1.99 * len(cuts)
    by_cut = {(r.day, r.window): r for r in found}
    for name in list(cuts)[::497]:
        first, last = cuts[name]
        for t in (day(690), day(691)):
            past = [v for d, v in held.items() if first <= d <= last and d.weekday() == t.weekday()]
            hits = sum(v is not None and v <= held[t] for v in past)
            row = by_cut[t, name]
            assert (row.window_start, row.window_end, row.days) == (first, last, len(past))
            assert abs(float(row.pct_at_or_below) - 100 * hits / len(past)) <= 0.0501


def test_cuts_keep_null_keys_and_drop_empty_windows(series):
    df = series(range(30), kind=PCT).withColumn("k", F.lit(None).cast("string"))
    cuts = {"all": (FIRST_DAY, FIRST_DAY + timedelta(days=29)), "none": (date(2020, 1, 1), date(2020, 2, 1))}
    found = position_by_window(df, "x", (date(2024, 1, 30),) * 2, cuts, ["k"]).collect()
    assert [(r.k, r.window, r.days, r.pct_at_or_below) for r in found] == [(None, "all", 5, D("100.0"))]
