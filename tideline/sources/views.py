"""Views that stay in the catalog, written from the parameters of the operators.

A permanent view is kept as SQL text, so these functions state in SQL what the operator
of the same name states in the DataFrame API; tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from tideline.functions.numbers import MONEY, PERCENT
from tideline.operators.variation import frame_bounds, row_days_ago, windowed
from tideline.sources.contracts import quoted, text


def _change(value: str, base: str, on_zero: str) -> str:
    if on_zero not in ("error", "null"):
        raise ValueError("on_zero is 'error' or 'null'")
    ratio = f"try_divide({value} - {base}, {base})" if on_zero == "null" else f"({value} - {base}) / {base}"
    return f"CAST({ratio} * 100 AS {PERCENT})"


def _weekday(table: str, day: str) -> str:
    return f"SELECT *, weekday({quoted(day)}) + 1 AS weekday FROM {table}"


def baseline_sql(
    table: str,
    metrics: Sequence[str],
    keys: Sequence[str] = (),
    weeks: int = 4,
    day: str = "day",
    frame: str = "rows",
    on_zero: str = "error",
) -> str:
    """``rolling_weekday_baseline`` of a table that has no column ``weekday`` of its own."""
    group, bounds = [*keys, "weekday"], frame_bounds(weeks, frame)
    means = [
        f"CAST({windowed(f'avg({quoted(m)})', group, day, bounds)} AS {MONEY}) AS {quoted(m + '_mean')}" for m in metrics
    ]
    size = f"{windowed('count(1)', group, day, bounds)} AS base_weeks"
    changes = [
        f"CASE WHEN base_weeks = {int(weeks)} THEN {_change(quoted(m), quoted(m + '_mean'), on_zero)} END AS {quoted(m + '_pct')}"
        for m in metrics
    ]
    inner = f"SELECT *, {', '.join([*means, size])} FROM ({_weekday(table, day)})"
    return f"SELECT *, {', '.join(changes)} FROM ({inner})"


def lag_sql(
    table: str,
    metrics: Sequence[str],
    keys: Sequence[str] = (),
    days: int = 364,
    day: str = "day",
    on_zero: str = "error",
) -> str:
    """``lag_variation`` of a table that has no column ``weekday`` of its own, for whole weeks."""
    if days % 7:
        raise ValueError("a view compares days that are whole weeks apart")
    partner = row_days_ago(metrics, [*keys, "weekday"], day, days)
    added = ["_previous.previous_day AS previous_day"]
    for m in metrics:
        before = f"_previous.{quoted(m)}"
        added.append(f"{before} AS {quoted(m + '_previous')}")
        added.append(f"{_change(quoted(m), before, on_zero)} AS {quoted(m + '_yoy_pct')}")
    inner = f"SELECT *, {partner} AS _previous FROM ({_weekday(table, day)})"
    return f"SELECT * EXCEPT (_previous), {', '.join(added)} FROM ({inner})"


def create_view(
    spark: SparkSession,
    name: str,
    sql: str,
    columns: Mapping[str, str],
    comments: Mapping[str, str],
    comment: str = "",
) -> None:
    """Keep the columns ``columns`` (old name: new name) of a statement as a view.

    The view is part of the catalog, with its comments, and reads its tables whenever
    it is read. Every column needs a comment.
    """
    lacking = [new for new in columns.values() if not comments.get(new)]
    if lacking:
        raise ValueError(f"no comment for {', '.join(lacking)}")
    named = ", ".join(f"{quoted(new)} COMMENT {text(comments[new])}" for new in columns.values())
    chosen = ", ".join(f"{quoted(old)} AS {quoted(new)}" for old, new in columns.items())
    spark.sql(f"CREATE OR REPLACE VIEW {name} ({named}) COMMENT {text(comment)} AS SELECT {chosen} FROM ({sql})")
