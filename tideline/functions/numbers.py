"""Exact arithmetic: means, percentages and shares with fixed decimal types."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result types. Money and percentages are never floating point.
MONEY = "decimal(18,2)"
PERCENT = "decimal(10,2)"
SHARE = "decimal(16,1)"


def money_sum(amount: Column | str) -> Column:
    """Sum of an amount whose rows are first brought to exact cents."""
    value = F.col(amount) if isinstance(amount, str) else amount
    return F.sum(value.cast(MONEY)).cast(MONEY)


def cents_sum(amount: Column | str) -> Column:
    """``money_sum`` for amounts stored as doubles, at a fraction of its cost.

    Casting a double to a decimal goes through its text form. A double that is
    a whole number of cents, as nearly all are, can be counted in cents instead;
    any other value still takes the cast, so the sums are the same.
    """
    value = F.col(amount) if isinstance(amount, str) else amount
    scaled = value * F.lit(100.0)
    whole = F.rint(scaled)
    safe = (F.abs(scaled - whole) < 1e-6) & (F.abs(whole) < 1e15)
    slow = (value.cast(MONEY) * 100).cast("bigint")
    cents = F.sum(F.when(safe, whole.cast("bigint")).otherwise(slow))
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def mean_as(value: Column | str, kind: str = MONEY) -> Column:
    """Average rounded half-up to ``kind``."""
    return F.avg(value).cast(kind)


def pct_change(value: Column, base: Column, on_zero: str = "error") -> Column:
    """(value - base) / base in percent, two places.

    ``on_zero="error"`` leaves a zero base to the session (ANSI mode raises);
    ``"null"`` returns NULL for it.
    """
    if on_zero == "null":
        ratio = F.try_divide(value - base, base)
    elif on_zero == "error":
        ratio = (value - base) / base
    else:
        raise ValueError("on_zero is 'error' or 'null'")
    return (ratio * 100).cast(PERCENT)


def count_where(condition: Column) -> Column:
    """Rows for which the condition is true; NULL counts as not true. 0 for no rows."""
    return F.count(F.when(condition, F.lit(1)))


def share_where(condition: Column, among: Column | None = None) -> Column:
    """Percentage of rows that meet a condition, one place.

    A NULL condition counts as not met. Rows outside ``among`` leave the
    denominator; with no row left the share is NULL.
    """
    hit = F.when(condition, F.lit(Decimal("1.0"))).otherwise(F.lit(0))
    counted = hit if among is None else F.when(among, hit)
    return F.round(100 * F.avg(counted), 1).cast(SHARE)


def share_of_counts(hits: Column, total: Column) -> Column:
    """The value ``share_where`` gives, from counts that are already known.

    An average of ones and zeros holds five decimal places before it is turned
    into a percentage, so the ratio is rounded there first.
    """
    ratio = F.when(total > 0, hits.cast("decimal(18,0)") / total.cast("decimal(18,0)"))
    return F.round(100 * ratio.cast("decimal(15,5)"), 1).cast(SHARE)
