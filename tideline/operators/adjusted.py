"""Comparisons that control for holidays, the month cycle, trend and event windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import days_to_month_end, month_slot
from tideline.functions.numbers import MONEY, mean_as, pct_change
from tideline.operators.distribution import within
from tideline.operators.series import with_weekday
from tideline.operators.windows import flag_days

Period = tuple[date, date]

WHOLE, EXACT = "decimal(19,0)", "decimal(38,0)"  # a summand, and sums and their products


def with_business_days(
    df: DataFrame,
    holidays: DataFrame | Column,
    keys: Sequence[str] = (),
    day: str = "day",
) -> DataFrame:
    """Holiday and business-day flags, and the business day's number in its month.

    Holidays are a table of days, or a condition on the day, which costs no join and no
    second input. Numbers count the days that are present: fill gaps first where that matters.
    """
    if isinstance(holidays, Column):
        out = with_weekday(df.withColumn("holiday", F.coalesce(holidays, F.lit(False))), day)
    else:
        out = with_weekday(flag_days(df, holidays, "holiday", day), day)
    working = (F.col("weekday") <= 5) & ~F.col("holiday")
    out = out.withColumns({"business_day": working, "_month": F.trunc(day, "month")})
    month = Window.partitionBy(*keys, "_month").orderBy(day)
    worked = F.sum(F.col("business_day").cast("int"))
    whole = month.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumns(
        {
            "business_day_number": F.when(F.col("business_day"), worked.over(so_far)),
            "business_days_in_month": worked.over(whole),
        }
    ).drop("_month")


def with_month_cycle(
    df: DataFrame,
    day: str = "day",
    edge_days: int = 5,
    pay_days: Sequence[int] = (),
) -> DataFrame:
    """Position in the month: days to its end, slot of the weekday, phase, pay day."""
    left = days_to_month_end(day)
    number = F.dayofmonth(day)
    phase = (
        F.when(number <= edge_days, "start")
        .when(left < edge_days, "end")
        .otherwise("middle")
    )
    return df.withColumns(
        {
            "day_of_month": number,
            "days_to_month_end": left,
            "month_slot": month_slot(day),
            "month_phase": phase,
            "pay_day": number.isin(*pay_days) if pay_days else F.lit(False),
        }
    )


def cycle_profile(
    df: DataFrame,
    metrics: Sequence[str],
    keys: Sequence[str] = (),
    day: str = "day",
    edge_days: int = 5,
) -> DataFrame:
    """Days and means per month phase and weekday."""
    placed = with_weekday(with_month_cycle(df, day, edge_days), day)
    return placed.groupBy(*keys, "month_phase", "weekday").agg(
        F.count(F.lit(1)).alias("days"), *[mean_as(m).alias(f"{m}_mean") for m in metrics]
    )


def trend_deviation(
    df: DataFrame,
    metric: str,
    fit: Period,
    keys: Sequence[str] = (),
    day: str = "day",
    by_weekday: bool = True,
    on_zero: str = "error",
) -> DataFrame:
    """Each day against a straight line fitted to a reference period.

    The line is fitted per series (and weekday) on days since the start of the
    reference period. Adds the slope, the expected value and the deviation in
    percent of it; NULL where fewer than two days support the line.

    The moments (n and the sums of x, y, x squared and x times y) are whole numbers and
    decimals, which add up to the same in any order; only the two quotients are rounded. Metrics
    have up to four decimal places.
    """
    df = with_weekday(df, day) if by_weekday else df
    group = Window.partitionBy(*keys, *(["weekday"] if by_weekday else []))
    x = F.datediff(F.col(day), F.lit(fit[0])).cast(WHOLE)
    y = F.when(within(day, fit), (F.col(metric).cast("decimal(20,4)") * 10_000).cast(WHOLE))
    known = F.when(y.isNotNull(), x)
    sums = {"n": F.count(y), "x": F.sum(known), "y": F.sum(y), "xx": F.sum(known * known), "xy": F.sum(known * y)}
    out = df.withColumns({f"_{name}": column.over(group) for name, column in sums.items()})
    n, sx, sy, sxx, sxy = (F.col(f"_{name}").cast(EXACT) for name in sums)
    spread = (n * sxx - sx * sx).cast("double")
    slope = (n * sxy - sx * sy).cast("double") / (spread * 10_000)
    intercept = (sy * sxx - sx * sxy).cast("double") / (spread * 10_000)
    fitted = F.when((F.col("_n") > 1) & (spread > 0), F.lit(True))
    expected = F.when(fitted, (intercept + slope * x.cast("double")).cast(MONEY))
    out = out.withColumns({"trend_slope": F.when(fitted, F.round(slope, 6)), "trend_expected": expected})
    return out.withColumn(
        "trend_pct", pct_change(F.col(metric), F.col("trend_expected"), on_zero)
    ).drop(*(f"_{name}" for name in sums))


def before_after(
    df: DataFrame,
    metrics: Sequence[str],
    markers: Mapping[str, date],
    days_before: int,
    days_after: int,
    keys: Sequence[str] = (),
    by_weekday: bool = False,
    day: str = "day",
    on_zero: str = "error",
) -> DataFrame:
    """Means before and after each marker date.

    The marker day closes the period before it. A day is copied only to the
    markers it is near to.
    """
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("marker"),
                F.lit(when).alias("marker_day"),
                F.lit(when - timedelta(days=days_before - 1)).alias("_from"),
                F.lit(when + timedelta(days=days_after)).alias("_to"),
            )
            for name, when in markers.items()
        ]
    )
    first = min(markers.values()) - timedelta(days=days_before - 1)
    last = max(markers.values()) + timedelta(days=days_after)
    near = df.filter(within(day, (first, last))).withColumn(
        "_m",
        F.explode(F.filter(listed, lambda m: F.col(day).between(m["_from"], m["_to"]))),
    ).select(*df.columns, "_m.marker", "_m.marker_day")
    if by_weekday:
        near = with_weekday(near, day)
    group = [*keys, "marker", "marker_day", *(["weekday"] if by_weekday else [])]
    earlier = F.col(day) <= F.col("marker_day")
    parts: list[Column] = [
        F.count(F.when(earlier, 1)).alias("days_before"),
        F.count(F.when(~earlier, 1)).alias("days_after"),
    ]
    for m in metrics:
        parts.append(mean_as(F.when(earlier, F.col(m))).alias(f"{m}_before"))
        parts.append(mean_as(F.when(~earlier, F.col(m))).alias(f"{m}_after"))
    return near.groupBy(*group).agg(*parts).withColumns(
        {
            f"{m}_change_pct": pct_change(F.col(f"{m}_after"), F.col(f"{m}_before"), on_zero)
            for m in metrics
        }
    )


def inside_outside(
    df: DataFrame,
    metric: str,
    flag: str,
    keys: Sequence[str] = (),
    strata: Sequence[str] = ("weekday",),
    day: str = "day",
    on_zero: str = "error",
) -> DataFrame:
    """Flagged days against the others: naive, and adjusted for their composition.

    Naive compares the two plain means. Adjusted compares the flagged total with
    what the same number of days per stratum would give at that stratum's
    unflagged mean; strata without unflagged days take no part.
    """
    rows = with_weekday(df, day) if "weekday" in strata else df
    value, inside = F.col(metric), F.col(flag)
    per_stratum = rows.groupBy(*keys, *strata).agg(
        F.count(F.when(inside, value)).alias("_n_in"),
        F.count(F.when(~inside, value)).alias("_n_out"),
        F.sum(F.when(inside, value)).alias("_sum_in"),
        F.sum(F.when(~inside, value)).alias("_sum_out"),
        mean_as(F.when(~inside, value)).alias("_mean_out"),
    )
    shared = (F.col("_n_in") > 0) & (F.col("_n_out") > 0)
    expected = F.col("_mean_out") * F.col("_n_in").cast("decimal(18,0)")
    totals = per_stratum.groupBy(*keys).agg(
        F.sum("_n_in").alias("days_inside"),
        F.sum("_n_out").alias("days_outside"),
        (F.sum("_sum_in").cast("decimal(38,2)") / F.sum("_n_in")).cast(MONEY).alias(
            "mean_inside"
        ),
        (F.sum("_sum_out").cast("decimal(38,2)") / F.sum("_n_out")).cast(MONEY).alias(
            "mean_outside"
        ),
        F.sum(F.when(shared, F.col("_sum_in"))).cast("decimal(38,2)").alias("_actual"),
        F.sum(F.when(shared, expected)).cast("decimal(38,2)").alias("_expected"),
    )
    return totals.withColumns(
        {
            "naive_pct": pct_change(F.col("mean_inside"), F.col("mean_outside"), on_zero),
            "adjusted_pct": pct_change(F.col("_actual"), F.col("_expected"), on_zero),
        }
    ).drop("_actual", "_expected")
