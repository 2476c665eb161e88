"""Column helpers; every one of them stays inside Spark's built-in expressions."""

from tideline.functions.dates import (
    days_to_month_end,
    is_weekend,
    iso_weekday,
    month_slot,
    span_days,
    weekday_label,
    week_start,
)
from tideline.functions.numbers import (
    MONEY,
    PERCENT,
    SHARE,
    cents_sum,
    count_where,
    mean_as,
    money_sum,
    pct_change,
    share_of_counts,
    share_where,
)

__all__ = [
    "MONEY",
    "PERCENT",
    "SHARE",
    "cents_sum",
    "count_where",
    "days_to_month_end",
    "is_weekend",
    "iso_weekday",
    "mean_as",
    "money_sum",
    "month_slot",
    "pct_change",
    "share_of_counts",
    "share_where",
    "span_days",
    "week_start",
    "weekday_label",
]
