"""SQL fragments for the statements the queries are checked against.

Means and percentages are stated in whole numbers (cents and hundredths of a
percent, rounded half away from zero), because the checking engine averages in
floating point.
"""

from __future__ import annotations

from collections.abc import Sequence


def dec(whole: str, scale: int, kind: str) -> str:
    """A whole number of 10^-scale units as a decimal."""
    unit = {1: "0.1", 2: "0.01"}[scale]
    return f"CAST(CAST({whole} AS DECIMAL(30,0)) * {unit} AS {kind})"


def money(cents: str) -> str:
    return dec(cents, 2, "DECIMAL(18,2)")


def percent(hundredths: str) -> str:
    return dec(hundredths, 2, "DECIMAL(10,2)")


def ratio(top: str, bottom: str, factor: int = 1) -> str:
    """top * factor / bottom to the nearest whole number, halves away from zero."""
    a = f"(CAST({top} AS HUGEINT) * {factor})"
    return (
        f"(sign({a}) * sign({bottom}) * "
        f"((2 * abs({a}) + abs({bottom})) // nullif(2 * abs({bottom}), 0)))"
    )


def change(value: str, base: str) -> str:
    """Percent change in hundredths, from whole numbers in the same unit."""
    return ratio(f"({value}) - ({base})", base, 10_000)


def share(hits: str, total: str) -> str:
    """Percentage to one place; the ratio passes through five places first."""
    five = ratio(hits, total, 100_000)
    return dec(f"(({five} + 50) // 100)", 1, "DECIMAL(16,1)")


def from_double(expr: str, kind: str = "DECIMAL(10,2)") -> str:
    """A double to a decimal by its shortest decimal form."""
    return f"CAST(CAST(({expr}) AS VARCHAR) AS {kind})"


def double_change(value: str, base: str) -> str:
    """Percent change of two counts, which is a division of doubles."""
    return from_double(f"({value} - {base})::DOUBLE / {base} * 100")


def key_list(keys: Sequence[str]) -> str:
    return "".join(f"{k}, " for k in keys)


def series(table: str, date_column: str, amount: str, keys: Sequence[str] = ()) -> str:
    """Daily roll-up: days, quantity, value in cents and as a decimal."""
    k = key_list(keys)
    return f"""
    SELECT {k}CAST({date_column} AS DATE) AS day,
           count(*) AS quantity,
           CAST(sum(CAST({amount} AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value,
           CAST(sum(CAST({amount} AS DECIMAL(18,2))) * 100 AS HUGEINT) AS cents,
           CAST(isodow(CAST({date_column} AS DATE)) AS INTEGER) AS weekday
    FROM {table} GROUP BY ALL"""


def shipments(keys: Sequence[str] = ()) -> str:
    return series("lineitem", "l_shipdate", "l_extendedprice", keys)


def sales(keys: Sequence[str] = ()) -> str:
    return series("orders", "o_orderdate", "o_totalprice", keys)


def baseline(
    source: str, keys: Sequence[str] = (), frame: str = "rows", weeks: int = 4
) -> str:
    """``source`` with mean, percentage and completeness, also as whole numbers."""
    k = key_list(keys)
    bounds = (
        f"ROWS BETWEEN {weeks} PRECEDING AND 1 PRECEDING"
        if frame == "rows"
        else f"RANGE BETWEEN INTERVAL {7 * weeks} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING"
    )
    qm, vm = "_q_mean", "_v_mean"
    return f"""
    SELECT * EXCLUDE (_qs, _vs, _q_mean, _v_mean, cents),
           {money(qm)} AS quantity_mean, {money(vm)} AS value_mean,
           CASE WHEN base_weeks = {weeks} THEN {percent(change('quantity * 100', qm))} END
             AS quantity_pct,
           CASE WHEN base_weeks = {weeks} THEN {percent(change('cents', vm))} END AS value_pct
    FROM (
      SELECT *, {ratio('_qs', 'base_weeks')} AS _q_mean, {ratio('_vs', 'base_weeks')} AS _v_mean
      FROM (
        SELECT *, sum(quantity * 100) OVER w AS _qs, sum(cents) OVER w AS _vs,
               count(*) OVER w AS base_weeks
        FROM ({source})
        WINDOW w AS (PARTITION BY {k}weekday ORDER BY day {bounds})))"""


def yearly(source: str, keys: Sequence[str] = (), days: int = 364) -> str:
    """``source`` joined with itself ``days`` earlier."""
    match = "".join(f" AND p.{k} = a.{k}" for k in keys)
    return f"""
    SELECT a.* EXCLUDE (cents), p.day AS previous_day,
           p.quantity AS quantity_previous,
           {double_change('a.quantity', 'p.quantity')} AS quantity_yoy_pct,
           p.value AS value_previous,
           {percent(change('a.cents', 'p.cents'))} AS value_yoy_pct
    FROM ({source}) a LEFT JOIN ({source}) p ON p.day = a.day - {days}{match}"""


def hundredths(decimal: str) -> str:
    """A two-place decimal as a whole number."""
    return f"CAST(({decimal}) * 100 AS HUGEINT)"


def interpolated(metric: str, p: float) -> str:
    """Exact percentile, weighted between its two neighbours in double arithmetic.

    ``quantile_cont`` adds a fraction of the difference to the lower neighbour
    instead, which lands on the other side of some half-cent ties.
    """
    values = f"list_sort(list(({metric})::DOUBLE) FILTER (WHERE {metric} IS NOT NULL))"
    at = f"((count({metric}) - 1) * {p}::DOUBLE)"
    low, high = f"floor({at})", f"ceil({at})"
    return (
        f"CASE WHEN {low} = {high} THEN {values}[{low}::BIGINT + 1] "
        f"ELSE ({high} - {at}) * {values}[{low}::BIGINT + 1] "
        f"+ ({at} - {low}) * {values}[{high}::BIGINT + 1] END"
    )


def percentiles(metric: str) -> str:
    return ", ".join(
        f"{from_double(interpolated(metric, p))} AS {name}"
        for p, name in ((0.5, "median_pct"), (0.05, "p05_pct"), (0.95, "p95_pct"))
    )


def share_where(condition: str, among: str = "true") -> str:
    return share(
        f"count(*) FILTER (WHERE ({condition}) AND ({among}))",
        f"count(*) FILTER (WHERE {among})",
    )
