from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideline.operators.quality import GateError
from tideline.operators.variation import lag_variation, rolling_weekday_baseline
from tideline.plans import settlements as study
from tideline.session import scratch_path
from tideline.sources import snapshots
from tideline.sources.contracts import SETTLEMENT_DAILY, SETTLEMENT_ENVELOPE

FIRST, LAST = date(2024, 6, 3), date(2026, 9, 28)


@pytest.fixture(scope="module")
def landing(spark):
    days = (LAST - FIRST).days + 1
    numbers = spark.range(days).select(
        F.date_format(F.date_add(F.lit(FIRST), F.col("id").cast("int")), "yyyy-MM-dd").alias(
            "Data"
        ),
        (1000 + F.pmod(F.col("id") * 7919, F.lit(997))).alias("Quantidade"),
        F.lit(None).cast("bigint").alias("CanalPrimario"),
        F.lit(None).cast("bigint").alias("CanalSecundario"),
        (2000 + F.pmod(F.col("id") * 104729, F.lit(1009))).cast("decimal(18,2)").alias("Total"),
        F.lit(Decimal("2.00")).cast("decimal(18,2)").alias("Media"),
    )
    directory = scratch_path(spark, "landing")
    snapshots.land_snapshot(numbers, directory, "day", SETTLEMENT_ENVELOPE)
    return directory


@pytest.fixture(scope="module")
def daily(spark, landing):
    table = scratch_path(spark, "daily")
    report = study.load_daily(spark, landing, "day", table)
    assert [r.action for r in report.collect()] == ["insert"]
    again = study.load_daily(spark, landing, "day", table)
    assert [r.action for r in again.collect()] == ["unchanged"]
    return study.read_settlements(spark, table).cache()


@pytest.fixture(scope="module")
def calendar(spark, tmp_path_factory):
    seed = tmp_path_factory.mktemp("seed") / "windows.csv"
    seed.write_text(
        "data_inicio,data_fim,tipo,fonte,observacao\n"
        "2026-09-21,2026-10-06,data_fifa,u,\n"
        "2026-06-11,2026-07-19,copa_do_mundo,u,x\n"
    )
    directory = scratch_path(spark, "windows")
    study.load_windows(spark, str(seed), directory)
    from tideline.sources.tables import read_current

    return read_current(spark, directory)


def test_table_is_as_declared(daily):
    assert daily.dtypes == [(c.name, c.type) for c in SETTLEMENT_DAILY.columns]
    row = daily.filter("data = '2026-09-26'").first()
    assert (row.dia_da_semana, row.nome_dia_da_semana, row.fim_de_semana) == (6, "sabado", True)
    assert row.valor_reais % 1000 == 0


def test_a_gap_stops_the_load(spark, landing):
    raw = snapshots.scan_snapshots(
        spark, snapshots.latest_snapshot(spark, landing, "day"), SETTLEMENT_ENVELOPE
    )
    broken, table = scratch_path(spark, "landing"), scratch_path(spark, "daily")
    snapshots.land_snapshot(
        raw.filter("Data != '2025-01-01'").drop("snapshot"), broken, "day", SETTLEMENT_ENVELOPE
    )
    with pytest.raises(GateError, match="miss days"):
        study.load_daily(spark, broken, "day", table)
    from tideline.sources import files

    assert not files.exists(spark, table)


def test_a_full_page_is_loaded_with_a_warning(spark, landing):
    table = scratch_path(spark, "daily")
    rows = (LAST - FIRST).days + 1
    with pytest.warns(UserWarning, match=f"{rows} rows, the cap is {rows}"):
        study.load_daily(spark, landing, "day", table, cap=rows)
    assert study.read_settlements(spark, table).count() == rows


def test_views_have_the_known_columns(daily):
    assert study.weekly_view(daily).dtypes == [
        ("data", "date"), ("dia_da_semana", "int"), ("nome_dia_da_semana", "string"),
        ("quantidade", "bigint"), ("media_quantidade_4_semanas", "decimal(18,2)"),
        ("variacao_quantidade_pct", "decimal(10,2)"), ("valor_reais", "decimal(18,2)"),
        ("media_valor_reais_4_semanas", "decimal(18,2)"),
        ("variacao_valor_reais_pct", "decimal(10,2)"), ("semanas_na_base", "bigint"),
    ]
    assert study.yearly_view(daily).dtypes == [
        ("data", "date"), ("dia_da_semana", "int"), ("nome_dia_da_semana", "string"),
        ("quantidade", "bigint"), ("data_ano_anterior", "date"),
        ("quantidade_ano_anterior", "bigint"), ("variacao_yoy_quantidade_pct", "decimal(10,2)"),
        ("valor_reais", "decimal(18,2)"), ("valor_reais_ano_anterior", "decimal(18,2)"),
        ("variacao_yoy_valor_reais_pct", "decimal(10,2)"),
    ]


def test_views_hold_the_general_results(daily):
    weekly = study.weekly_view(daily).select("data", "variacao_quantidade_pct").collect()
    general = rolling_weekday_baseline(daily, study.METRICS, day="data")
    assert sorted(weekly, key=lambda r: r[0]) == sorted(
        general.select("data", "quantidade_pct").collect(), key=lambda r: r[0]
    )
    yearly = study.yearly_view(daily).select("data", "variacao_yoy_valor_reais_pct").collect()
    general = lag_variation(daily, study.METRICS, day="data")
    assert sorted(yearly, key=lambda r: r[0]) == sorted(
        general.select("data", "valor_reais_yoy_pct").collect(), key=lambda r: r[0]
    )


def test_integrity_and_profile(daily):
    n = (LAST - FIRST).days + 1
    assert tuple(study.weekly_integrity(daily).first()) == (n, n, 28, 0)
    assert tuple(study.yearly_integrity(daily).first()) == (n, n, 364, 0)
    assert tuple(study.profile(daily).first()) == (n, FIRST, LAST, 0)


def test_analyses(spark, daily, calendar):
    weekly, yearly = study.weekly_view(daily), study.yearly_view(daily)
    figures = study.published_figures(spark, weekly).collect()
    assert [r.quantidade_divulgada for r in figures] == [229600000, 165900000, 213000000]

    years = study.by_year(weekly)
    assert years.columns == [
        "ano", "dias", "mediana_pct", "p05_pct", "p95_pct",
        "pct_dias_queda_10_ou_mais", "pct_dias_alta_10_ou_mais",
    ]
    # Days of 2026 up to the day before the period under study, as published.
    assert {r.ano: r.dias for r in years.collect()}[2026] == 268

    weekdays = {r.dia_da_semana: r.dias for r in study.by_weekday(weekly).collect()}
    assert weekdays == {1: 52, 2: 52, 3: 52, 4: 52, 5: 53, 6: 52, 7: 52}

    placed = study.position_weekly(weekly)
    assert placed.columns == [
        "data", "nome_dia_da_semana", "variacao_dia_pct", "dias_12m",
        "pct_igual_ou_pior_12m", "dias_24m", "pct_igual_ou_pior_24m",
    ]
    assert [(r.dias_12m, r.dias_24m) for r in placed.collect()] == [(52, 104)] * 3
    assert [r.dias_24m for r in study.position_yearly(yearly).collect()] == [104] * 3

    drops = study.weekend_drops(weekly).collect()
    assert drops and all(r.variacao_quantidade_pct <= -10 for r in drops)

    both = study.both_methods(weekly, yearly).collect()
    assert [str(r.data_ano_anterior) for r in both] == ["2025-09-27", "2025-09-28", "2025-09-29"]
    assert study.yearly_vs_recent(yearly).columns == [
        "data", "nome_dia_da_semana", "yoy_quantidade_pct", "media_yoy_4_semanas_pct",
        "diferenca_pp",
    ]
    # Nine Saturdays, Sundays and Mondays each, from 1 August to 28 September.
    assert study.yearly_base(yearly).count() == 27
    trend = study.yearly_trend(yearly).collect()
    assert [r.dias for r in trend] == [7] * 10 + [1]

    kinds = study.windows_by_kind(calendar).collect()
    assert [(r.tipo, r.janelas) for r in kinds] == [("copa_do_mundo", 1), ("data_fifa", 1)]
    flags = study.flagged_days(daily, calendar).collect()
    assert [r.em_janela_fifa for r in flags] == [
        r.data >= date(2026, 9, 21) for r in flags
    ] and flags[0].data == LAST and len(flags) == 14


def test_views_are_open_to_sql(spark, daily):
    study.register_views(daily, "weekly", "yearly")
    row = spark.sql(
        "SELECT count(*) AS n FROM yearly AS y JOIN weekly AS w USING (data)"
    ).first()
    assert row.n == (LAST - FIRST).days + 1
    assert timedelta(days=364) == date(2026, 9, 26) - date(2025, 9, 27)
