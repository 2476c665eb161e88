"""How often a variation of a given size occurs: distributions, positions, lists, trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import week_start
from tideline.functions.numbers import (
    PERCENT,
    count_where,
    mean_as,
    share_of_counts,
    share_where,
)
from tideline.operators.series import with_weekday

Period = tuple[date, date]

RANGE = 16  # points of variation whose values one task counts one by one
POINTS = {"median_pct": 0.5, "p05_pct": 0.05, "p95_pct": 0.95}


def within(day: str, period: Period) -> Column:
    """Inclusive date range."""
    return F.col(day).between(F.lit(period[0]), F.lit(period[1]))


def distribution(
    df: DataFrame,
    metric: str,
    by: Sequence[str | Column],
    keys: Sequence[str] = (),
    low: float = -10,
    high: float | None = 10,
    count_low: bool = False,
    only_known: bool = True,
    period: Period | None = None,
    through: date | None = None,
    day: str = "day",
) -> DataFrame:
    """Days, exact median, p05 and p95, and the share of days beyond thresholds.

    ``only_known`` drops NULL variations first. Without it they stay in ``days``
    and in the denominator of the shares, while the percentiles skip them.

    Percentiles interpolate between neighbours, and no task holds a group. Rows are
    folded to (group, value, count); counts of ranges of ``RANGE`` points add up to the rank
    at which each range starts; only the ranges that hold a wanted rank are then
    counted value by value.
    """
    if only_known:
        df = df.filter(F.col(metric).isNotNull())
    if period is not None:
        df = df.filter(within(day, period))
    if through is not None:
        df = df.filter(F.col(day) <= F.lit(through))
    counted = df.groupBy(*keys, *by, F.col(metric).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    group = counted.columns[:-2]
    counted = counted.withColumn("_range", F.floor(F.col("_value") / RANGE).cast("bigint"))

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    known, value = F.col("_range").isNotNull(), F.col("_value")
    ranges = counted.groupBy(*group, "_range").agg(
        F.sum("_n").alias("_n"), rows_where(value <= low).alias("_low"), rows_where(value >= (high or 0)).alias("_high")
    )
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    so_far = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known_rows = F.when(known, F.col("_n")).otherwise(0)
    sums = {"_days": F.col("_n"), "_lows": F.col("_low"), "_highs": F.col("_high"), "_known": known_rows}
    ranges = ranges.withColumns({name: F.sum(column).over(whole) for name, column in sums.items()})
    ranges = ranges.withColumn("_before", F.sum(known_rows).over(so_far) - known_rows)

    place = {name: (F.col("_known") - 1) * F.lit(share) for name, share in POINTS.items()}
    ranks = [edge(p).cast("bigint") for p in place.values() for edge in (F.floor, F.ceil)]
    inside = lambda r, first, n: known & (r >= F.col(first)) & (r < F.col(first) + F.col(n))
    wanted = reduce(or_, (inside(r, "_before", "_n") for r in ranks), F.col("_known") == 0)
    chosen = ranges.filter(wanted).drop("_low", "_high", "_n")
    chosen = chosen.withColumnsRenamed({c: f"_of_{c}" for c in [*group, "_range"]})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*group, "_range"]))
    within_range = Window.partitionBy(*group, "_range").orderBy("_value")
    upto = F.sum("_n").over(within_range.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    values = counted.join(chosen, same).withColumn("_start", F.col("_before") + upto - F.col("_n"))

    found = [F.max(c).alias(c) for c in sums]
    for i, rank in enumerate(ranks):
        found.append(F.max(F.when(inside(rank, "_start", "_n"), value.cast("double"))).alias(f"_at{i}"))
    grouped = values.groupBy(*group).agg(*found)
    columns = [F.col("_days").alias("days"), share_of_counts(F.col("_lows"), F.col("_days")).alias("pct_days_low")]
    if count_low:
        columns.append(F.col("_lows").alias("days_low"))
    if high is not None:
        columns.append(share_of_counts(F.col("_highs"), F.col("_days")).alias("pct_days_high"))
    for i, (name, at) in enumerate(place.items()):
        lower, upper = F.col(f"_at{2 * i}"), F.col(f"_at{2 * i + 1}")
        between = (F.ceil(at) - at) * lower + (at - F.floor(at)) * upper
        columns.append(F.when(lower == upper, lower).otherwise(between).cast(PERCENT).alias(name))
    return grouped.select(*group, *columns)


def _ranked(
    rows: DataFrame, metric: str, group: Sequence[str], members: Mapping[str, Column]
) -> DataFrame:
    # For every row: how many members of the group there are, and how many of them
    # hold a value at or below its own. One ordered pass instead of pairing each
    # target with each day of its history.
    order = Window.partitionBy(*group).orderBy(F.col(metric).asc_nulls_first())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col(metric).isNotNull()
    counts = {}
    for name, member in members.items():
        counts[f"_n_{name}"] = count_where(member).over(whole)
        counts[f"_le_{name}"] = count_where(member & known).over(so_far)
    return rows.withColumns(counts)


def position_in_history(
    df: DataFrame,
    metric: str,
    targets: Period,
    windows: Mapping[str, Period],
    keys: Sequence[str] = (),
    strata: Sequence[str] = ("weekday",),
    history: Column | None = None,
    day: str = "day",
) -> DataFrame:
    """Share of comparable past days whose variation was equal or worse.

    Comparable means the same series and the same ``strata`` (the weekday). For
    each window label the result holds ``days_<label>`` and
    ``pct_at_or_below_<label>``. A NULL on either side counts as not worse; a
    target without any comparable day is left out. ``history`` narrows the past
    days further. Name the keys of a keyed series: a ranked group is then one
    weekday of one series.
    """
    df = with_weekday(df, day) if "weekday" in strata else df
    is_target = within(day, targets)
    allowed = F.lit(True) if history is None else F.coalesce(history, F.lit(False))
    members = {name: within(day, period) & allowed for name, period in windows.items()}
    relevant = df.filter(reduce(or_, members.values(), is_target))
    ranked = _ranked(relevant, metric, [*keys, *strata], members)
    seen = reduce(or_, (F.col(f"_n_{name}") > 0 for name in windows))
    known = F.col(metric).isNotNull()
    columns = []
    for name in windows:
        total = F.col(f"_n_{name}")
        worse = F.when(known, F.col(f"_le_{name}")).otherwise(F.lit(0))
        columns.append(total.alias(f"days_{name}"))
        columns.append(share_of_counts(worse, total).alias(f"pct_at_or_below_{name}"))
    return ranked.filter(is_target & seen).select(*keys, day, *strata, metric, *columns)


def position_by_window(
    df: DataFrame,
    metric: str,
    targets: Period,
    windows: Mapping[str, Period],
    keys: Sequence[str] = (),
    strata: Sequence[str] = ("weekday",),
    day: str = "day",
) -> DataFrame:
    """``position_in_history`` with one row per target and window.

    Meant for sensitivity checks over many cuts, thousands if need be. A target's comparable
    days are counted once, in date order, and the counts are read off at the days on which
    some window starts or ends; a window is then the difference of two of them. No day is
    copied per window.
    """
    df = with_weekday(df, day) if "weekday" in strata else df
    group = [*keys, *strata]
    ends = sorted({d for first, last in windows.values() for d in (first - timedelta(days=1), last)})
    place = {d: i + 1 for i, d in enumerate(ends)}
    chosen = df.filter(within(day, targets)).select(
        *[F.col(c).alias(f"_of_{c}") for c in group], F.col(day).alias("_day"), F.col(metric).alias("_value")
    )
    past = df.filter(within(day, (ends[0] + timedelta(days=1), ends[-1]))).select(*group, F.col(day).alias("_at"), F.col(metric).alias("_past"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group), F.lit(True))
    target = [*(f"_of_{c}" for c in group), "_day", "_value"]
    worse = F.coalesce((F.col("_past") <= F.col("_value")).cast("int"), F.lit(0))
    met = chosen.join(past, same).select(*target, "_at", F.lit(1).alias("_one"), worse.alias("_worse"))
    edges = F.split(F.lit(",".join(d.isoformat() for d in ends)), ",").cast("array<date>")
    marks = chosen.select(*target, F.explode(edges).alias("_at"), F.lit(0).alias("_one"), F.lit(0).alias("_worse"))
    upto = Window.partitionBy(*target).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = met.union(marks).withColumns({"_n": F.sum("_one").over(upto), "_le": F.sum("_worse").over(upto)})
    # One array per target: the counts at every edge, in order.
    at_edges = F.array_sort(F.collect_set(F.when(F.col("_at").isin(ends), F.struct("_at", "_n", "_le"))))
    read = counted.groupBy(*target).agg(at_edges.alias("_edges"))

    names = F.split(F.lit("\x1f".join(windows)), "\x1f")
    first, last = (
        F.split(F.lit(",".join(str(place[d]) for d in days)), ",").cast("array<int>")
        for days in ([a - timedelta(days=1) for a, _ in windows.values()], [b for _, b in windows.values()])
    )
    cut = F.explode(F.arrays_zip(names.alias("window"), first.alias("first"), last.alias("last")))
    rows = read.select("*", cut.alias("_cut"))
    before, until = F.element_at("_edges", F.col("_cut.first")), F.element_at("_edges", F.col("_cut.last"))
    rows = rows.withColumns({"days": until["_n"] - before["_n"], "_hits": until["_le"] - before["_le"]})
    return rows.filter("days > 0").select(
        *[F.col(f"_of_{c}").alias(c) for c in keys],
        F.col("_day").alias(day),
        *[F.col(f"_of_{c}").alias(c) for c in strata],
        F.col("_value").alias(metric),
        F.col("_cut.window").alias("window"),
        F.date_add(before["_at"], 1).alias("window_start"),
        until["_at"].alias("window_end"),
        "days",
        share_of_counts(F.col("_hits"), F.col("days")).alias("pct_at_or_below"),
    )


def exceedances(
    df: DataFrame,
    metric: str,
    threshold: float,
    weekdays: Sequence[int],
    period: Period,
    day: str = "day",
) -> DataFrame:
    """Days of the given weekdays whose variation is at or below a threshold."""
    chosen = with_weekday(df, day).filter(
        within(day, period) & F.col("weekday").isin(*weekdays) & (F.col(metric) <= threshold)
    )
    return chosen.orderBy(day)


def base_detail(
    df: DataFrame,
    weekdays: Sequence[int],
    period: Period,
    keys: Sequence[str] = (),
    day: str = "day",
) -> DataFrame:
    """The comparison base day by day, ordered by weekday number and date."""
    chosen = with_weekday(df, day).filter(
        within(day, period) & F.col("weekday").isin(*weekdays)
    )
    return chosen.orderBy(*keys, "weekday", day)


def weekly_trend(
    df: DataFrame,
    metrics: Sequence[str],
    period: Period | None = None,
    keys: Sequence[str] = (),
    day: str = "day",
) -> DataFrame:
    """Days and mean variation per week, Monday to Sunday."""
    rows = df if period is None else df.filter(within(day, period))
    means = [F.round(F.avg(m), 2).alias(f"{m}_mean") for m in metrics]
    return rows.groupBy(*keys, week_start(day).alias("week_start")).agg(
        F.count(F.lit(1)).alias("days"), *means
    )


def weekday_means(
    df: DataFrame,
    metrics: Sequence[str],
    keys: Sequence[str] = (),
    period: Period | None = None,
    day: str = "day",
) -> DataFrame:
    """Days and mean of each metric per weekday."""
    rows = with_weekday(df if period is None else df.filter(within(day, period)), day)
    return rows.groupBy(*keys, "weekday").agg(
        F.count(F.lit(1)).alias("days"), *[mean_as(m).alias(f"{m}_mean") for m in metrics]
    )
