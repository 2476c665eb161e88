"""The daily settlement study, ready to run: loads, views and analyses under the
column names its users know. Every step is one of the general operators."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.dates import WEEKDAYS_PT
from tideline.operators import quality
from tideline.operators.compare import inline, reconcile, side_by_side
from tideline.operators.distribution import (
    base_detail,
    distribution,
    exceedances,
    position_in_history,
    weekly_trend,
    within,
)
from tideline.operators.series import latest_days, with_calendar
from tideline.operators.variation import (
    lag_variation,
    rolling_weekday_baseline,
    variation_vs_recent,
)
from tideline.operators.windows import flag_windows, window_profile
from tideline.sources import snapshots
from tideline.sources.contracts import (
    SETTLEMENT_DAILY,
    SETTLEMENT_ENVELOPE,
    WINDOW_KINDS,
    WINDOW_SEED,
)
from tideline.sources.seeds import read_window_seed
from tideline.sources.tables import publish_version, read_daily, upsert_daily, upsert_table
from tideline.sources.views import baseline_sql, create_view, lag_sql

Period = tuple[date, date]

# The days under study, their history and the published figures.
DAYS: Period = (date(2026, 9, 26), date(2026, 9, 28))
HISTORY_END = date(2026, 9, 25)
HISTORY: dict[str, Period] = {
    "12m": (date(2025, 9, 26), HISTORY_END),
    "24m": (date(2024, 9, 26), HISTORY_END),
}
EIGHT_WEEKS: Period = (date(2026, 8, 1), date(2026, 9, 28))
TREND: Period = (date(2026, 7, 20), date(2026, 9, 28))
PUBLISHED = (
    (date(2026, 9, 26), 229600000, Decimal("-11.0")),
    (date(2026, 9, 27), 165900000, Decimal("-12.0")),
    (date(2026, 9, 28), 213000000, Decimal("-7.4")),
)
SNAPSHOT_CAP = 10_000
DAY, METRICS = "data", ("quantidade", "valor_reais")
COMPARED = SETTLEMENT_ENVELOPE.payload

# General column -> column of the study.
CALENDAR_NAMES = {
    "year": "ano",
    "month": "mes",
    "day_of_month": "dia_do_mes",
    "weekday": "dia_da_semana",
    "weekday_name": "nome_dia_da_semana",
    "weekend": "fim_de_semana",
}
WEEKLY_NAMES = {
    "data": "data",
    "dia_da_semana": "dia_da_semana",
    "nome_dia_da_semana": "nome_dia_da_semana",
    "quantidade": "quantidade",
    "quantidade_mean": "media_quantidade_4_semanas",
    "quantidade_pct": "variacao_quantidade_pct",
    "valor_reais": "valor_reais",
    "valor_reais_mean": "media_valor_reais_4_semanas",
    "valor_reais_pct": "variacao_valor_reais_pct",
    "base_weeks": "semanas_na_base",
}
YEARLY_NAMES = {
    "data": "data",
    "dia_da_semana": "dia_da_semana",
    "nome_dia_da_semana": "nome_dia_da_semana",
    "quantidade": "quantidade",
    "previous_day": "data_ano_anterior",
    "quantidade_previous": "quantidade_ano_anterior",
    "quantidade_yoy_pct": "variacao_yoy_quantidade_pct",
    "valor_reais": "valor_reais",
    "valor_reais_previous": "valor_reais_ano_anterior",
    "valor_reais_yoy_pct": "variacao_yoy_valor_reais_pct",
}
VIEW_COMMENTS = {
    "data": "settlement day, unique",
    "dia_da_semana": "1 = Monday ... 7 = Sunday",
    "nome_dia_da_semana": "name of the weekday",
    "quantidade": "transactions settled",
    "media_quantidade_4_semanas": "mean of up to four preceding same weekdays, two places",
    "variacao_quantidade_pct": "change against that mean in percent; NULL unless all four are there",
    "valor_reais": "amount settled",
    "media_valor_reais_4_semanas": "mean of up to four preceding same weekdays, two places",
    "variacao_valor_reais_pct": "change against that mean in percent; NULL unless all four are there",
    "semanas_na_base": "weekdays in the mean, 0 to 4",
    "data_ano_anterior": "the day 364 days earlier; NULL where the series lacks it",
    "quantidade_ano_anterior": "transactions settled that day",
    "variacao_yoy_quantidade_pct": "change against that day in percent",
    "valor_reais_ano_anterior": "amount settled that day",
    "variacao_yoy_valor_reais_pct": "change against that day in percent",
}
DISTRIBUTION_NAMES = {
    "days": "dias",
    "median_pct": "mediana_pct",
    "p05_pct": "p05_pct",
    "p95_pct": "p95_pct",
    "days_low": "dias_queda_10_ou_mais",
    "pct_days_low": "pct_dias_queda_10_ou_mais",
    "pct_days_high": "pct_dias_alta_10_ou_mais",
}


def _named(df: DataFrame, names: Mapping[str, str], first: Sequence[str] = ()) -> DataFrame:
    kept = [F.col(old).alias(new) for old, new in names.items() if old in df.columns]
    return df.select(*first, *kept)


# Loads


def typed_daily(raw: DataFrame) -> DataFrame:
    """Snapshot rows as the declared daily table."""
    typed = with_calendar(
        snapshots.typed_rows(raw, SETTLEMENT_ENVELOPE), DAY, WEEKDAYS_PT
    ).withColumnsRenamed(CALENDAR_NAMES)
    return SETTLEMENT_DAILY.conform(typed)


def _newest(spark: SparkSession, landing: str, prefix: str) -> tuple[str, DataFrame]:
    newest = snapshots.latest_snapshot(spark, landing, prefix)
    return newest, typed_daily(snapshots.scan_snapshots(spark, newest, SETTLEMENT_ENVELOPE))


def _series_check(staged: DataFrame) -> DataFrame:
    return quality.series_report(staged, DAY, required=SETTLEMENT_DAILY.required)


def _loaded(report: DataFrame, newest: str, cap: int) -> DataFrame:
    rows = sum(r["rows"] for r in report.collect())
    if rows >= cap:
        warnings.warn(f"{newest} has {rows} rows, the cap is {cap}", stacklevel=3)
    return report


def load_daily(
    spark: SparkSession, landing: str, prefix: str, table: str, cap: int = SNAPSHOT_CAP
) -> DataFrame:
    """Newest snapshot into the daily table, a folder; rows per action.

    The snapshot is read once. Its typed rows are staged, the staged rows are checked, and
    they are what is stored. Nothing is written unless they have no missing or repeated
    date and no gap. A snapshot as long as the page cap may have been cut off: it is
    loaded with a warning.
    """
    newest, batch = _newest(spark, landing, prefix)
    keys = list(SETTLEMENT_DAILY.key)
    return _loaded(upsert_daily(spark, batch, table, keys, COMPARED, DAY, _series_check), newest, cap)


def load_table(
    spark: SparkSession, landing: str, prefix: str, table: str, cap: int = SNAPSHOT_CAP
) -> DataFrame:
    """``load_daily`` into a catalog table, which is declared if it is not there yet."""
    SETTLEMENT_DAILY.create(spark, table, by_month=DAY)
    newest, batch = _newest(spark, landing, prefix)
    return _loaded(upsert_table(batch, table, COMPARED, _series_check), newest, cap)


def read_settlements(spark: SparkSession, table: str) -> DataFrame:
    return SETTLEMENT_DAILY.conform(read_daily(spark, table, SETTLEMENT_DAILY.schema))


def load_windows(spark: SparkSession, seed: str, directory: str) -> str:
    """The window seed as a new version of the calendar; the written rows are checked first."""
    calendar = read_window_seed(spark, seed, WINDOW_SEED)
    return publish_version(
        calendar,
        directory,
        required=WINDOW_SEED.required,
        check=lambda rows: quality.calendar_report(
            rows, WINDOW_KINDS, WINDOW_SEED.required, "tipo", "data_inicio", "data_fim"
        ),
    )


# Views


def weekly_view(daily: DataFrame) -> DataFrame:
    """Each day against the mean of the four preceding same weekdays."""
    return _named(rolling_weekday_baseline(daily, METRICS, day=DAY), WEEKLY_NAMES)


def yearly_view(daily: DataFrame) -> DataFrame:
    """Each day against the weekday-aligned day a year earlier."""
    return _named(lag_variation(daily, METRICS, day=DAY), YEARLY_NAMES)


def register_views(daily: DataFrame, weekly_name: str, yearly_name: str) -> None:
    """Make both views available to SQL in the session, under names of choice."""
    weekly_view(daily).createOrReplaceTempView(weekly_name)
    yearly_view(daily).createOrReplaceTempView(yearly_name)


def create_views(spark: SparkSession, table: str, weekly_name: str, yearly_name: str) -> None:
    """Keep both views of a catalog table in the catalog, with a comment per view and column."""
    create_view(
        spark,
        weekly_name,
        baseline_sql(table, METRICS, day=DAY),
        WEEKLY_NAMES,
        VIEW_COMMENTS,
        "each day against the mean of the four preceding same weekdays; describes, claims no cause",
    )
    create_view(
        spark,
        yearly_name,
        lag_sql(table, METRICS, day=DAY),
        YEARLY_NAMES,
        VIEW_COMMENTS,
        "each day against the day 364 days earlier; includes the yearly trend; describes, claims no cause",
    )


def weekly_integrity(daily: DataFrame) -> DataFrame:
    view = rolling_weekday_baseline(daily, METRICS, day=DAY)
    names = {
        "source_rows": "linhas_silver",
        "view_rows": "linhas_view",
        "incomplete_bases": "sem_base_completa",
        "unexpected_nulls": "nulos_inesperados",
    }
    return _named(quality.baseline_integrity(daily, view, METRICS[0], day=DAY), names)


def yearly_integrity(daily: DataFrame) -> DataFrame:
    view = lag_variation(daily, METRICS, day=DAY)
    names = {
        "source_rows": "linhas_silver",
        "view_rows": "linhas_view",
        "without_partner": "sem_ano_anterior",
        "weekday_mismatches": "dia_da_semana_diferente",
    }
    return _named(quality.lag_integrity(daily, view, DAY), names)


def profile(daily: DataFrame) -> DataFrame:
    names = {
        "rows": "linhas",
        "first_day": "primeira_data",
        "last_day": "ultima_data",
        "duplicates": "duplicadas",
    }
    return _named(quality.table_profile(daily, DAY), names)


# Analyses


def published_figures(spark: SparkSession, weekly: DataFrame, figures=PUBLISHED) -> DataFrame:
    """Published counts and percentages beside the calculated ones."""
    published = inline(
        spark,
        figures,
        "data date, quantidade_divulgada int, variacao_divulgada_pct decimal(3,1)",
    )
    names = {
        "data": "data",
        "nome_dia_da_semana": "nome_dia_da_semana",
        "quantidade": "quantidade_calculada",
        "quantidade_divulgada": "quantidade_divulgada",
        "media_quantidade_4_semanas": "media_quantidade_4_semanas",
        "variacao_quantidade_pct": "variacao_calculada_pct",
        "variacao_divulgada_pct": "variacao_divulgada_pct",
        "variacao_valor_reais_pct": "variacao_valor_calculada_pct",
    }
    return _named(reconcile(weekly, published, [DAY]), names).orderBy(DAY)


def by_year(weekly: DataFrame, through: date = HISTORY_END) -> DataFrame:
    table = distribution(
        weekly, "variacao_quantidade_pct", [F.year(DAY).alias("ano")], through=through, day=DAY
    )
    return _named(table, DISTRIBUTION_NAMES, ["ano"]).orderBy("ano")


def by_weekday(weekly: DataFrame, period: Period = HISTORY["12m"]) -> DataFrame:
    group = ["dia_da_semana", "nome_dia_da_semana"]
    table = distribution(
        weekly,
        "variacao_quantidade_pct",
        group,
        high=None,
        count_low=True,
        only_known=False,
        period=period,
        day=DAY,
    )
    return _named(table, DISTRIBUTION_NAMES, group).orderBy("dia_da_semana")


def _position(view: DataFrame, metric: str, name: str, days: Period, history) -> DataFrame:
    found = position_in_history(
        view, metric, days, history, strata=["dia_da_semana", "nome_dia_da_semana"], day=DAY
    )
    names = {DAY: DAY, "nome_dia_da_semana": "nome_dia_da_semana", metric: name}
    for label in history:
        names[f"days_{label}"] = f"dias_{label}"
        names[f"pct_at_or_below_{label}"] = f"pct_igual_ou_pior_{label}"
    return _named(found, names).orderBy(DAY)


def position_weekly(weekly: DataFrame, days: Period = DAYS, history=HISTORY) -> DataFrame:
    return _position(weekly, "variacao_quantidade_pct", "variacao_dia_pct", days, history)


def position_yearly(yearly: DataFrame, days: Period = DAYS, history=HISTORY) -> DataFrame:
    return _position(yearly, "variacao_yoy_quantidade_pct", "yoy_dia_pct", days, history)


def weekend_drops(weekly: DataFrame, period: Period = HISTORY["24m"]) -> DataFrame:
    listed = exceedances(weekly, "variacao_quantidade_pct", -10, (6, 7), period, DAY)
    return listed.select(
        "data",
        "nome_dia_da_semana",
        "quantidade",
        "media_quantidade_4_semanas",
        "variacao_quantidade_pct",
    )


def both_methods(weekly: DataFrame, yearly: DataFrame, days: Period = DAYS) -> DataFrame:
    recent = weekly.select(DAY, "variacao_quantidade_pct", "variacao_valor_reais_pct")
    names = {
        "data": "data",
        "nome_dia_da_semana": "nome_dia_da_semana",
        "data_ano_anterior": "data_ano_anterior",
        "variacao_quantidade_pct": "noticia_quantidade_pct",
        "variacao_yoy_quantidade_pct": "yoy_quantidade_pct",
        "variacao_valor_reais_pct": "noticia_valor_pct",
        "variacao_yoy_valor_reais_pct": "yoy_valor_pct",
    }
    joined = side_by_side(yearly, recent, [DAY]).filter(within(DAY, days))
    return _named(joined, names).orderBy(DAY)


def yearly_vs_recent(yearly: DataFrame, days: Period = DAYS) -> DataFrame:
    metric = "variacao_yoy_quantidade_pct"
    names = {
        "data": "data",
        "nome_dia_da_semana": "nome_dia_da_semana",
        metric: "yoy_quantidade_pct",
        f"{metric}_recent_mean": "media_yoy_4_semanas_pct",
        f"{metric}_gap_pp": "diferenca_pp",
    }
    compared = variation_vs_recent(yearly, metric, day=DAY)
    return _named(compared.filter(within(DAY, days)), names).orderBy(DAY)


def yearly_base(yearly: DataFrame, period: Period = EIGHT_WEEKS) -> DataFrame:
    return base_detail(yearly, (6, 7, 1), period, day=DAY).select(
        "nome_dia_da_semana",
        "data",
        "data_ano_anterior",
        "variacao_yoy_quantidade_pct",
        "variacao_yoy_valor_reais_pct",
    )


def yearly_trend(yearly: DataFrame, period: Period = TREND) -> DataFrame:
    metrics = ["variacao_yoy_quantidade_pct", "variacao_yoy_valor_reais_pct"]
    names = {
        "week_start": "semana_inicio",
        "days": "dias",
        f"{metrics[0]}_mean": "yoy_quantidade_medio_pct",
        f"{metrics[1]}_mean": "yoy_valor_medio_pct",
    }
    return _named(weekly_trend(yearly, metrics, period, day=DAY), names).orderBy(
        "semana_inicio"
    )


def windows_by_kind(calendar: DataFrame) -> DataFrame:
    names = {
        "tipo": "tipo",
        "windows": "janelas",
        "first_day": "primeira_data",
        "last_day": "ultima_data",
    }
    found = window_profile(calendar, "tipo", "data_inicio", "data_fim")
    return _named(found, names).orderBy("tipo")


def flagged_days(
    daily: DataFrame,
    calendar: DataFrame,
    kind: str = WINDOW_KINDS[0],
    name: str = "em_janela_fifa",
    newest: int = 14,
) -> DataFrame:
    flagged = flag_windows(
        daily.select("data", "quantidade"),
        calendar,
        kind,
        name,
        DAY,
        start="data_inicio",
        end="data_fim",
        kind_column="tipo",
    )
    return latest_days(flagged, newest, DAY)
