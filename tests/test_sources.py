import json
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tideline.operators.quality import GateError
from tideline.session import scratch_path, shared_folder
from tideline.sources import files, snapshots
from tideline.sources.contracts import (
    SETTLEMENT_ENVELOPE as LAYOUT,
    WINDOW_SEED,
    EnvelopeField,
    EnvelopeLayout,
)
from tideline.sources.seeds import read_window_seed

ROW = {"Data": "2024-01-01", "Quantidade": 5, "CanalPrimario": None,
       "CanalSecundario": None, "Total": 12.5, "Media": 2.5}


def document(directory: Path, name: str, *rows, text: str | None = None) -> str:
    directory.mkdir(exist_ok=True)
    path = directory / name
    path.write_text(text if text is not None else json.dumps({"value": list(rows)}, indent=1))
    return str(path)


def raw(spark, *dates):
    return spark.createDataFrame(
        [(d, i + 1, None, None, Decimal("1.50"), Decimal("0.50")) for i, d in enumerate(dates)],
        LAYOUT.row_schema,
    )


def test_single_document(spark, tmp_path):
    document(tmp_path / "s", "pay_2024-01-01T000000Z.json", ROW)
    document(tmp_path / "s", "pay_2024-01-02T000000Z.json", ROW, {**ROW, "Data": "2024-01-02"})
    document(tmp_path / "s", "pay_2024-01-03.json", ROW)
    document(tmp_path / "s", "other_2024-01-09T000000Z.json", ROW)
    typed = snapshots.ingest_snapshot(spark, str(tmp_path / "s"), "pay", LAYOUT)
    rows = typed.orderBy("data").collect()
    assert [r.data for r in rows] == [date(2024, 1, 1), date(2024, 1, 2)]
    assert rows[0].valor_reais == Decimal("12500.00")
    assert rows[0].quantidade_canal_primario is None
    assert dict(typed.dtypes)["valor_medio_reais"] == "decimal(18,2)"


def test_unit_conversion_rounds_at_the_declared_scale(spark, tmp_path):
    path = document(tmp_path / "s", "p_2024-01-01T000000Z.json", {**ROW, "Total": 12.345})
    typed = snapshots.typed_rows(snapshots.scan_snapshots(spark, path, LAYOUT), LAYOUT)
    assert typed.first().valor_reais == Decimal("12350.00")
    fields = [
        EnvelopeField("Total", "decimal(18,5)", "valor_reais", "decimal(18,2)", 1000)
        if f.source == "Total" else f
        for f in LAYOUT.fields
    ]
    finer = EnvelopeLayout(tuple(fields), "Data", "data")
    typed = snapshots.typed_rows(snapshots.scan_snapshots(spark, path, finer), finer)
    assert typed.first().valor_reais == Decimal("12345.00")


@pytest.mark.parametrize(
    "text",
    [
        '{"value": [{"Data": "2024-01-01", "Quantidade": 5',
        '{"value": [{"Data": "2024-01-01", "Quantidade": "many"}]}',
    ],
)
def test_broken_documents_stop_the_read(spark, tmp_path, text):
    path = document(tmp_path / "s", "p_2024-01-01T000000Z.json", text=text)
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ_FILE"):
        snapshots.scan_snapshots(spark, path, LAYOUT).collect()


def test_bad_date_stops_the_typing(spark, tmp_path):
    path = document(tmp_path / "s", "p_2024-01-01T000000Z.json", {**ROW, "Data": "2024-13-01"})
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|CAST_INVALID"):
        snapshots.typed_rows(snapshots.scan_snapshots(spark, path, LAYOUT), LAYOUT).collect()


def test_landing_is_append_only(spark):
    directory = scratch_path(spark, "land")
    with pytest.raises(FileNotFoundError):
        snapshots.latest_snapshot(spark, directory, "pay")
    snapshots.land_snapshot(raw(spark, "2024-01-01"), directory, "pay", LAYOUT, "2024-01-01T000000Z")
    later = raw(spark, "2024-01-01", "2024-01-02", "2024-02-01")
    path = snapshots.land_snapshot(later, directory, "pay", LAYOUT, "2024-01-02T000000Z")
    assert snapshots.latest_snapshot(spark, directory, "pay") == path
    assert snapshots.ingest_snapshot(spark, directory, "pay", LAYOUT).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        snapshots.land_snapshot(later, directory, "pay", LAYOUT, "2024-01-02T000000Z")
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert [len(line["value"]) for line in lines] == [1, 1, 1]
    assert lines[0]["value"][0]["CanalPrimario"] is None
    profile = snapshots.snapshot_profile(
        snapshots.scan_snapshots(spark, f"{directory}/pay_*", LAYOUT), LAYOUT, cap=3
    ).orderBy("snapshot")
    assert [tuple(r) for r in profile.collect()] == [
        ("2024-01-01T000000Z", 1, 1, "2024-01-01", "2024-01-01", False),
        ("2024-01-02T000000Z", 3, 3, "2024-01-01", "2024-02-01", True),
    ]


def test_nothing_is_landed_without_fields_or_rows(spark):
    directory = scratch_path(spark, "land")
    with pytest.raises(GateError, match="lacks Total"):
        snapshots.land_snapshot(raw(spark, "2024-01-01").drop("Total"), directory, "p", LAYOUT)
    with pytest.raises(GateError, match="empty"):
        snapshots.land_snapshot(raw(spark, "2024-01-01").limit(0), directory, "p", LAYOUT)
    assert files.stamped(spark, directory, "p") == []


def test_unfinished_directories_are_not_snapshots(spark, tmp_path):
    (tmp_path / "p_2024-01-05T000000Z").mkdir()
    document(tmp_path, "p_2024-01-01T000000Z.json", ROW)
    assert snapshots.latest_snapshot(spark, str(tmp_path), "p").endswith("01T000000Z.json")


def test_documents_and_directories_are_not_mixed(spark):
    with pytest.raises(ValueError):
        snapshots.scan_snapshots(spark, ["a.json", "b"], LAYOUT)


def test_stamps_sort_by_time():
    stamp = files.stamp_now()
    assert __import__("re").fullmatch(files.STAMP_PATTERN, stamp)


HEADER = "data_inicio,data_fim,tipo,fonte,observacao\n"


def seed(tmp_path, text):
    path = tmp_path / "seed.csv"
    path.write_text(text)
    return str(path)


def test_seed(spark, tmp_path):
    path = seed(tmp_path, HEADER + '2024-01-01,2024-01-05,cup,http://u,"a, b"\n2024-02-01,2024-02-02,cup,u,\n')
    rows = read_window_seed(spark, path, WINDOW_SEED).collect()
    assert [(r.data_inicio, r.observacao) for r in rows] == [
        (date(2024, 1, 1), "a, b"), (date(2024, 2, 1), None),
    ]


@pytest.mark.parametrize(
    "text",
    [
        HEADER + "2024-01-01,2024-31-05,cup,u,x\n",
        "data_fim,data_inicio,tipo,fonte,observacao\n2024-01-01,2024-01-05,cup,u,x\n",
        HEADER + "2024-01-01,2024-01-05\n",
    ],
)
def test_bad_seeds_stop_the_read(spark, tmp_path, text):
    with pytest.raises(Exception, match="(?i)malformed|header|FAILED_READ_FILE"):
        read_window_seed(spark, seed(tmp_path, text), WINDOW_SEED).collect()


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "a").startswith(shared_folder(spark) + "/a-")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == named.rstrip("/")


def test_null_required_values_pass_the_reader(spark, tmp_path):
    path = seed(tmp_path, HEADER + "2024-01-01,2024-01-05,,u,x\n")
    assert read_window_seed(spark, path, WINDOW_SEED).filter(F.col("tipo").isNull()).count() == 1


def test_scratch_needs_a_shared_folder_off_local_masters():
    from types import SimpleNamespace

    from tideline.session import shared_folder

    far = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *a: None),
        sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(far)


def test_inline_without_rows(spark):
    from tideline.operators.compare import inline

    assert inline(spark, [], "day date, x int").collect() == []
