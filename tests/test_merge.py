from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.operators.merge import merge_report, merge_rows
from tideline.operators.quality import GateError
from tideline.session import scratch_path
from tideline.sources.tables import (
    overwrite_table,
    publish_version,
    read_current,
    read_daily,
    upsert_daily,
    write_daily,
)

SCHEMA = "day date, x bigint, note string"
FIRST = date(2024, 1, 1)
cell = st.one_of(st.none(), st.integers(0, 2))
table = st.dictionaries(st.integers(0, 80), st.tuples(cell, st.sampled_from("ab")), max_size=20)
relaxed = settings(
    max_examples=12, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)


def frame(spark, rows):
    return spark.createDataFrame(
        [(FIRST + timedelta(days=d), x, n) for d, (x, n) in rows.items()], SCHEMA
    )


def model(old, new):
    out = {}
    for d in old.keys() | new.keys():
        if d not in old:
            out[d] = (*new[d], "insert")
        elif d not in new:
            out[d] = (*old[d], "kept")
        elif old[d][0] == new[d][0]:
            out[d] = (*old[d], "unchanged")
        else:
            out[d] = (*new[d], "update")
    return out


@relaxed
@given(table, table)
def test_merge_matches_a_plain_model(spark, old, new):
    merged = merge_rows(frame(spark, old), frame(spark, new), ["day"], ["x"])
    got = {(r.day - FIRST).days: (r.x, r.note, r.action) for r in merged.collect()}
    want = model(old, new)
    assert got == want
    report = {r.action: r.rows for r in merge_report(merged).collect()}
    actions = [row[2] for row in want.values()]
    assert report == {a: actions.count(a) for a in set(actions)}


def test_null_is_a_value(spark):
    old, new = {0: (None, "a"), 1: (None, "a"), 2: (5, "a")}, {0: (None, "b"), 1: (5, "b"), 2: (None, "b")}
    merged = merge_rows(frame(spark, old), frame(spark, new), ["day"], ["x"])
    assert [r.action for r in merged.orderBy("day").collect()] == ["unchanged", "update", "update"]


@settings(
    max_examples=4, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(table.filter(bool), table.filter(bool))
def test_stored_upsert_matches_the_query(spark, old, new):
    path = scratch_path(spark, "t")
    write_daily(frame(spark, old), path)
    report = upsert_daily(spark, frame(spark, new), path, ["day"], ["x"])
    stored = read_daily(spark, path, frame(spark, {}).schema)
    got = {(r.day - FIRST).days: (r.x, r.note) for r in stored.collect()}
    want = model(old, new)
    assert got == {d: row[:2] for d, row in want.items()}
    # The report covers the rows of the batch.
    actions = [row[2] for d, row in want.items() if d in new]
    assert {r.action: r.rows for r in report.collect()} == {
        a: actions.count(a) for a in set(actions)
    }


def test_upserts_that_would_lose_something_are_refused(spark):
    path = scratch_path(spark, "t")
    stored = frame(spark, {0: (1, "a"), 40: (2, "b")}).withColumn("extra", F.lit("kept"))
    write_daily(stored, path)
    batch = frame(spark, {0: (5, "c")})
    with pytest.raises(GateError, match="differ in their columns"):
        upsert_daily(spark, batch, path, ["day"], ["x"])
    other = batch.withColumns({"extra": F.lit("e"), "x": F.col("x").cast("string")})
    with pytest.raises(GateError, match="differ in their columns"):
        upsert_daily(spark, other, path, ["day"], ["x"])
    with pytest.raises(ValueError, match="one of the keys"):
        upsert_daily(spark, stored, path, ["note"], ["x"])
    with pytest.raises(GateError, match="taken by"):
        write_daily(batch.withColumn("stored_month", F.lit("m")), scratch_path(spark, "t"))
    assert sorted(r.x for r in read_daily(spark, path, stored.schema).collect()) == [1, 2]
    whole = stored.filter("x = 1").withColumn("x", F.col("x") + 8)
    assert [(r.action, r.rows) for r in upsert_daily(spark, whole, path, ["day"], ["x"]).collect()] == [("update", 1)]
    assert {(r.x, r.extra) for r in read_daily(spark, path, stored.schema).collect()} == {(9, "kept"), (2, "kept")}


def test_calendar_columns_can_be_stored(spark):
    from tideline.operators.series import with_calendar

    path = scratch_path(spark, "t")
    rows = with_calendar(frame(spark, {0: (1, "a")}))
    write_daily(rows, path)
    upsert_daily(spark, rows.withColumn("x", F.col("x") + 1), path, ["day"], ["x"])
    assert [(r.x, r.month) for r in read_daily(spark, path, rows.schema).collect()] == [(2, 1)]


def test_upsert_twice_changes_nothing_and_leaves_files_alone(spark, tmp_path):
    path = scratch_path(spark, "t")
    rows = {d: (d, "a") for d in range(70)}
    first = upsert_daily(spark, frame(spark, rows), path, ["day"], ["x"])
    assert [(r.action, r.rows) for r in first.collect()] == [("insert", 70)]
    before = sorted(spark.read.parquet(path).inputFiles())
    again = upsert_daily(spark, frame(spark, rows), path, ["day"], ["x"])
    assert [(r.action, r.rows) for r in again.collect()] == [("unchanged", 70)]
    assert sorted(spark.read.parquet(path).inputFiles()) == before
    # A revision in February leaves the January files as they are.
    upsert_daily(spark, frame(spark, {40: (99, "z")}), path, ["day"], ["x"])
    after = set(spark.read.parquet(path).inputFiles())
    kept = {f for f in before if "month=2024-01" in f or "month=2024-03" in f}
    assert kept <= after
    stored = read_daily(spark, path, frame(spark, {}).schema)
    assert stored.filter("x = 99").count() == 1 and stored.count() == 70


def test_repeated_keys_are_rejected_before_writing(spark):
    path = scratch_path(spark, "t")
    upsert_daily(spark, frame(spark, {0: (1, "a")}), path, ["day"], ["x"])
    twice = frame(spark, {0: (2, "b")}).union(frame(spark, {0: (3, "c")}))
    with pytest.raises(GateError, match="repeat a key"):
        upsert_daily(spark, twice, path, ["day"], ["x"])
    with pytest.raises(GateError, match="empty"):
        upsert_daily(spark, twice.limit(0), path, ["day"], ["x"])
    dateless = twice.limit(1).withColumn("day", F.lit(None).cast("date"))
    with pytest.raises(GateError, match="lack a required value"):
        upsert_daily(spark, dateless, path, ["day"], ["x"])
    assert read_daily(spark, path, twice.schema).first().x == 1


def test_published_versions(spark):
    directory = scratch_path(spark, "v")
    with pytest.raises(FileNotFoundError):
        read_current(spark, directory)
    publish_version(spark.range(3), directory, "2024-01-01T000000Z")
    publish_version(spark.range(5), directory, "2024-01-02T000000Z")
    assert read_current(spark, directory).count() == 5
    with pytest.raises(Exception, match="(?i)exists"):
        publish_version(spark.range(1), directory, "2024-01-02T000000Z")
    # A version without its completion mark is not read.
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{directory}/version_2024-01-03T000000Z"
    )
    assert read_current(spark, directory).count() == 5


def test_catalog_overwrite_keeps_the_declaration(spark, tmp_path):
    from tideline.sources.contracts import Column, TableContract

    contract = TableContract(
        (Column("d", "date", True, "the day"), Column("n", "int")), ("d",), "two columns"
    )
    spark.sql(f"CREATE DATABASE IF NOT EXISTS tide LOCATION '{tmp_path}/tide'")
    try:
        contract.create(spark, "tide.t")
        contract.create(spark, "tide.t")
        rows = spark.createDataFrame([("2024-01-01", "3", 0)], "d string, n string, other int")
        for _ in range(2):
            overwrite_table(contract.conform(rows), "tide.t")
        assert [tuple(r) for r in spark.table("tide.t").collect()] == [(date(2024, 1, 1), 3)]
        described = {r.col_name: r.comment for r in spark.sql("DESCRIBE tide.t").collect()}
        assert described["d"] == "the day"
    finally:
        spark.sql("DROP DATABASE tide CASCADE")


def test_contract_rejects_a_missing_column(spark):
    from tideline.sources.contracts import Column, TableContract

    contract = TableContract((Column("d", "date"),), ("d",))
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        contract.conform(spark.range(1).select(F.lit(1).alias("e")))


def test_months_of_the_batch_prune_the_table(spark):
    from tideline.sources import tables

    path = scratch_path(spark, "t")
    rows = {d: (d, "a") for d in range(80)}
    write_daily(frame(spark, rows), path)
    months = spark.createDataFrame([("2024-02",)], "stored_month string")
    pruned = tables._in_months(read_daily(spark, path, frame(spark, {}).schema), months)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stored_month" in plan and "2024-02" in plan
    assert pruned.count() == 29


def test_upsert_over_several_months(spark):
    path = scratch_path(spark, "t")
    write_daily(frame(spark, {d: (d, "a") for d in range(80)}), path)
    new = {40: (1, "b"), 70: (70, "b"), 100: (5, "b")}
    report = upsert_daily(spark, frame(spark, new), path, ["day"], ["x"])
    # February and March are touched: one day changed, one new, one the same.
    assert {r.action: r.rows for r in report.collect()} == {"insert": 1, "update": 1, "unchanged": 1}
    stored = read_daily(spark, path, frame(spark, {}).schema)
    assert stored.count() == 81 and stored.filter("note = 'b'").count() == 2


def test_rows_in_chosen_months(spark):
    from tideline.sources import tables

    rows = spark.createDataFrame([("2024-01", 1), ("2024-02", 2), ("2024-03", 3)], "stored_month string, x int")
    months = rows.filter("x <> 2").select("stored_month")
    assert sorted(r.x for r in tables._in_months(rows, months).collect()) == [1, 3]

