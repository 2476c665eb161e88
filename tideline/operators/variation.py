"""Comparing each day with its own past.

All of these work on a daily series (one row per keys and day). A window
partition is one weekday of one series, hence never longer than the number of
weeks in the calendar however large the facts were: a hot key is already folded
by the roll-up before it gets here.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numbers import MONEY, PERCENT, pct_change
from tideline.operators.series import with_weekday

Period = tuple[date, date]


def _quoted(*names: str) -> list[str]:
    return ["`" + name.replace("`", "``") + "`" for name in names]


def windowed(call: str, partition: Sequence[str], day: str, bounds: str) -> str:
    """A call over the days of a partition, in order.

    Written as SQL because only there a range bound may be an interval. Ordering by
    the date itself lets all windows of a series share one sort; rangeBetween() takes
    numbers and would need an order of its own.
    """
    spread, order = ", ".join(_quoted(*partition)), _quoted(day)[0]
    return f"{call} OVER (PARTITION BY {spread} ORDER BY {order} {bounds})"


def frame_bounds(weeks: int, frame: str) -> str:
    """The preceding same weekdays: so many rows, or so many weeks of the calendar."""
    if frame == "rows":
        return f"ROWS BETWEEN {int(weeks)} PRECEDING AND 1 PRECEDING"
    if frame == "calendar":
        back = f"INTERVAL {7 * int(weeks)} DAYS PRECEDING"
        return f"RANGE BETWEEN {back} AND INTERVAL 1 DAYS PRECEDING"
    raise ValueError("frame is 'rows' or 'calendar'")


def row_days_ago(columns: Sequence[str], partition: Sequence[str], day: str, days: int) -> str:
    """The day ``days`` earlier and its ``columns``, found by a range of width zero."""
    fields = ", ".join([f"{_quoted(day)[0]} AS previous_day", *_quoted(*columns)])
    back = f"INTERVAL {int(days)} DAYS PRECEDING"
    return windowed(f"first(struct({fields}))", partition, day, f"RANGE BETWEEN {back} AND {back}")


def look_back(
    df: DataFrame, period: Period, keys: Sequence[str] = (), weeks: int = 4, day: str = "day"
) -> date | None:
    """From which day on the series decides the row frames of a period; None if only all of it does.

    A frame that is full within a cut of the series is the frame of the whole series, as the
    rows before it are the nearest ones. So the days of the period are counted on the cut by
    their own look-back: if each has ``weeks`` same weekdays before it, the cut is
    proven, whatever lies outside. If not, days are missing or the series starts there, and longer
    cuts are tried. This runs now, and reads days and keys of the cut alone.
    """
    group = [*keys, "weekday"]
    for reach in (1, 4, 16):
        start = period[0] - timedelta(days=7 * weeks * reach)
        near = with_weekday(df.filter(F.col(day).between(F.lit(start), F.lit(period[1]))), day)
        size = F.expr(windowed("count(1)", group, day, frame_bounds(weeks, "rows")))
        counted = near.select(*group, day).withColumn("_n", size)
        if counted.filter(F.col(day).between(*map(F.lit, period)) & (F.col("_n") < weeks)).isEmpty():
            return start
    return None


def rolling_weekday_baseline(
    df: DataFrame,
    metrics: Sequence[str],
    keys: Sequence[str] = (),
    weeks: int = 4,
    day: str = "day",
    frame: str = "rows",
    on_zero: str = "error",
    only: Period | None = None,
    contiguous: bool = False,
    prove: bool = False,
) -> DataFrame:
    """Each day against the mean of the preceding same weekdays.

    Adds per metric ``<m>_mean`` (two places) and ``<m>_pct``, and
    ``base_weeks``, the rows in the frame. The percentage uses the rounded mean
    and is NULL unless the frame is complete; the mean is filled regardless.

    ``frame="rows"`` takes the previous ``weeks`` rows and equals the calendar
    frame when no day is missing; ``"calendar"`` looks back ``7 * weeks`` days.

    ``only`` keeps a period of result days. The input is then cut to that period
    plus its look-back where this cannot change the result: for the calendar
    frame, when ``prove`` has ``look_back`` find out how far row frames reach, or when the
    caller vouches that the series is ``contiguous``.
    """
    if only is not None:
        since = None
        if contiguous or frame == "calendar":
            since = only[0] - timedelta(days=7 * weeks)
        elif prove:
            since = look_back(df, only, keys, weeks, day)
        if since is not None:
            df = df.filter(F.col(day).between(F.lit(since), F.lit(only[1])))
    group, bounds = [*keys, "weekday"], frame_bounds(weeks, frame)
    means = {
        f"{m}_mean": F.expr(windowed(f"avg({_quoted(m)[0]})", group, day, bounds)).cast(MONEY)
        for m in metrics
    }
    out = with_weekday(df, day).withColumns(
        {**means, "base_weeks": F.expr(windowed("count(1)", group, day, bounds))}
    )
    complete = F.col("base_weeks") == weeks
    out = out.withColumns(
        {
            f"{m}_pct": F.when(complete, pct_change(F.col(m), F.col(f"{m}_mean"), on_zero))
            for m in metrics
        }
    )
    return out if only is None else out.filter(F.col(day).between(*map(F.lit, only)))


def lag_variation(
    df: DataFrame,
    metrics: Sequence[str],
    keys: Sequence[str] = (),
    days: int = 364,
    day: str = "day",
    on_zero: str = "error",
    only: Period | None = None,
) -> DataFrame:
    """Each day against the day exactly ``days`` earlier; NULL where there is none.

    Adds ``previous_day`` and per metric ``<m>_previous`` and ``<m>_yoy_pct``.
    A range frame of width zero finds the partner by date, so missing days are
    harmless and the series is read and shuffled once instead of joined with
    itself. With whole weeks the partner is in the same weekday partition and
    the shuffle of the baseline is reused; otherwise rows are placed by their
    day number modulo ``days``.
    """
    if only is not None:
        start, end = only
        reach = start - timedelta(days=days)
        span = F.col(day).between(F.lit(start), F.lit(end))
        partner = F.col(day).between(F.lit(reach), F.lit(end - timedelta(days=days)))
        df = df.filter(span | partner)
    df = with_weekday(df, day)
    if days % 7 == 0:
        out = df.withColumn(
            "_previous", F.expr(row_days_ago(metrics, [*keys, "weekday"], day, days))
        )
    else:
        df = df.withColumn("_place", F.pmod(F.unix_date(F.col(day)), F.lit(days)))
        out = df.withColumn(
            "_previous", F.expr(row_days_ago(metrics, [*keys, "_place"], day, days))
        ).drop("_place")
    added = {"previous_day": F.col("_previous.previous_day")}
    for m in metrics:
        before = F.col("_previous")[m]
        added[f"{m}_previous"] = before
        added[f"{m}_yoy_pct"] = pct_change(F.col(m), before, on_zero)
    out = out.withColumns(added).drop("_previous")
    return out if only is None else out.filter(F.col(day).between(*map(F.lit, only)))


def both_variations(
    df: DataFrame,
    metrics: Sequence[str],
    keys: Sequence[str] = (),
    weeks: int = 4,
    days: int = 364,
    day: str = "day",
    on_zero: str = "error",
    only: Period | None = None,
) -> DataFrame:
    """Baseline and yearly comparison of the same days, from one pass over the series.

    For a period, the input is cut to its days, their proven look-back and their partners:
    full frames take the nearest rows and never reach a partner a year back.
    """
    if only is not None and (since := look_back(df, only, keys, weeks, day)) is not None:
        partners = [F.lit(d - timedelta(days=days)) for d in only]
        recent = F.col(day).between(F.lit(since), F.lit(only[1]))
        df = df.filter(recent | F.col(day).between(*partners))
    recent = rolling_weekday_baseline(df, metrics, keys, weeks, day, on_zero=on_zero)
    both = lag_variation(recent, metrics, keys, days, day, on_zero)
    return both if only is None else both.filter(F.col(day).between(*map(F.lit, only)))


def variation_vs_recent(
    df: DataFrame,
    metric: str,
    keys: Sequence[str] = (),
    weeks: int = 4,
    day: str = "day",
    frame: str = "rows",
) -> DataFrame:
    """A variation against the mean of itself over the preceding same weekdays.

    Adds ``<metric>_recent_mean`` and ``<metric>_gap_pp`` (percentage points,
    taken from the unrounded mean). NULL variations are skipped by the mean and
    the frame need not be complete.
    """
    call = f"avg({_quoted(metric)[0]})"
    mean = F.expr(windowed(call, [*keys, "weekday"], day, frame_bounds(weeks, frame)))
    out = with_weekday(df, day).withColumn("_mean", mean)
    return out.withColumns(
        {
            f"{metric}_recent_mean": F.col("_mean").cast(PERCENT),
            f"{metric}_gap_pp": (F.col(metric) - F.col("_mean")).cast(PERCENT),
        }
    ).drop("_mean")


def period_total(
    df: DataFrame,
    metrics: Sequence[str],
    targets: Period,
    keys: Sequence[str] = (),
    day: str = "day",
    on_zero: str = "error",
) -> DataFrame:
    """Total of several days against the sum of their baselines (``<m>_mean``).

    NULL when any of the days has no baseline: a partial sum would compare
    unequal sets of days.
    """
    chosen = df.filter(F.col(day).between(*map(F.lit, targets)))
    sums = [F.count(F.lit(1)).alias("days")]
    for m in metrics:
        whole = F.count(f"{m}_mean") == F.count(F.lit(1))
        sums.append(F.sum(m).alias(f"{m}_total"))
        sums.append(F.when(whole, F.sum(f"{m}_mean")).alias(f"{m}_base_total"))
    totals = chosen.groupBy(*keys).agg(*sums)
    return totals.withColumns(
        {
            f"{m}_total_pct": pct_change(
                F.col(f"{m}_total"), F.col(f"{m}_base_total"), on_zero
            )
            for m in metrics
        }
    )
