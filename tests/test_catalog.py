"""Tables and views by name: declarations, checked writes, upserts, views that stay."""

from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.operators.quality import GateError, null_report
from tideline.operators.variation import lag_variation, rolling_weekday_baseline
from tideline.session import scratch_path
from tideline.sources import files
from tideline.sources.contracts import Column, TableContract, declaration, enforced
from tideline.sources.tables import (
    overwrite_table,
    publish_version,
    read_current,
    upsert_table,
    write_daily,
)
from tideline.sources.views import baseline_sql, create_view, lag_sql

FIRST = date(2024, 1, 1)
CONTRACT = TableContract(
    (
        Column("shop", "string", True, "where; it's `quoted`"),
        Column("day", "date", True, "when"),
        Column("x", "bigint", True, "how many"),
        Column("note", "string"),
    ),
    ("shop", "day"),
    "sales, a shop's day",
)


@pytest.fixture
def database(spark):
    path = scratch_path(spark, "db")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def frame(spark, rows):
    data = [(shop, FIRST + timedelta(days=d), x, note) for (shop, d), (x, note) in rows.items()]
    return spark.createDataFrame(data, "shop string, day date, x bigint, note string")


def held(spark, table):
    return {(r.shop, (r.day - FIRST).days): (r.x, r.note) for r in spark.table(table).collect()}


def test_declaration(spark, database):
    table = f"{database}.t"
    for _ in range(2):
        CONTRACT.create(spark, table, by_month="day")
    described = {r.col_name: r.comment for r in spark.sql(f"DESCRIBE {table}").collect()}
    assert described["shop"] == "where; it's `quoted`" and described["x"] == "how many"
    found = declaration(spark, table)
    assert (found.key, set(found.required), found.day) == (("shop", "day"), {"shop", "day", "x"}, "day")
    comments = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    assert comments["Comment"] == "sales, a shop's day"
    spark.range(1).write.saveAsTable(f"{database}.plain")
    assert declaration(spark, f"{database}.plain").required == ()
    with pytest.raises(ValueError, match="declared by month"):
        upsert_table(frame(spark, {}), f"{database}.plain", ["x"])
    with pytest.raises(ValueError, match="one of the keys"):
        CONTRACT.create(spark, f"{database}.u", by_month="note")


def test_enforced_rows(spark):
    rows = frame(spark, {("a", 0): (1, None), ("b", 1): (2, "n")})
    assert sorted(enforced(rows, ["x", "day"]).collect()) == sorted(rows.collect())
    text = enforced(rows, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Aggregate" not in text
    with pytest.raises(Exception, match="rows lack a required value: note"):
        enforced(rows, ["note"]).collect()
    with pytest.raises(ValueError, match="no column"):
        enforced(rows, ["other"])


def test_writers_refuse_rows_without_a_required_value(spark, database):
    good, bad = {("a", 0): (1, "n")}, {("a", 0): (5, "n"), ("a", 1): (None, "n")}
    table, path, directory = f"{database}.t", scratch_path(spark, "d"), scratch_path(spark, "v")
    CONTRACT.create(spark, table)
    overwrite_table(frame(spark, good), table)
    with pytest.raises(GateError, match="required value: x"):
        overwrite_table(frame(spark, bad), table)
    assert held(spark, table) == good

    publish_version(frame(spark, good), directory, "2024-01-01T000000Z", CONTRACT.required)
    with pytest.raises(GateError, match="required value: x"):
        publish_version(frame(spark, bad), directory, "2024-01-02T000000Z", CONTRACT.required)
    with pytest.raises(GateError, match="lack a required value"):
        publish_version(frame(spark, bad), directory, "2024-01-02T000000Z", check=lambda df: null_report(df, ["x"]))
    assert read_current(spark, directory).count() == 1
    publish_version(frame(spark, bad).filter("x > 0"), directory, "2024-01-02T000000Z", CONTRACT.required)

    with pytest.raises(GateError, match="required value: x"):
        write_daily(frame(spark, bad), path, required=["x"])
    with pytest.raises(GateError, match="required value: day"):
        write_daily(frame(spark, good).withColumn("day", F.lit(None).cast("date")), path)
    assert not files.exists(spark, path)
    write_daily(frame(spark, good), path, required=["x"])
    with pytest.raises(FileExistsError):
        write_daily(frame(spark, good), path)


cell = st.tuples(st.integers(0, 2), st.sampled_from("ab"))
rows = st.dictionaries(st.tuples(st.sampled_from("pq"), st.integers(0, 70)), cell, min_size=1, max_size=15)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows, rows)
def test_upsert_matches_a_plain_model(spark, database, old, new):
    table = f"{database}.t"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    CONTRACT.create(spark, table, by_month="day")
    first = upsert_table(frame(spark, old), table, ["x"])
    assert [(r.action, r.rows) for r in first.collect()] == [("insert", len(old))]
    report = {r.action: r.rows for r in upsert_table(frame(spark, new), table, ["x"]).collect()}
    want, actions = dict(old), []
    for key, value in new.items():
        action = "insert" if key not in old else "unchanged" if old[key][0] == value[0] else "update"
        actions.append(action)
        if action != "unchanged":
            want[key] = value
    assert held(spark, table) == want
    assert report == {a: actions.count(a) for a in set(actions)}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def test_upserts_that_are_refused_change_nothing(spark, database):
    table = f"{database}.t"
    CONTRACT.create(spark, table, by_month="day")
    good = {("a", 0): (1, "n"), ("a", 40): (2, "n")}
    upsert_table(frame(spark, good), table, ["x"])
    batch = frame(spark, {("a", 0): (9, "m")})
    refused = {
        "repeat a key": batch.union(batch),
        "empty": batch.limit(0),
        "required value: x": batch.withColumn("x", F.lit(None).cast("bigint")),
        "required value: day": batch.withColumn("day", F.lit(None).cast("date")),
        "differ in their columns": batch.drop("note"),
        "(?i)bigint": batch.withColumn("x", F.col("x").cast("int")),
    }
    for what, rows in refused.items():
        with pytest.raises(GateError, match=what):
            upsert_table(rows, table, ["x"])
    with pytest.raises(GateError, match="lack a required value"):
        upsert_table(batch.withColumn("note", F.lit(None).cast("string")), table, ["x"], lambda df: null_report(df, ["note"]))
    assert held(spark, table) == good


def test_upsert_leaves_other_months_alone(spark, database):
    table = f"{database}.t"
    CONTRACT.create(spark, table, by_month="day")
    upsert_table(frame(spark, {("a", d): (d, "n") for d in range(80)}), table, ["x"])
    before = set(spark.table(table).inputFiles())
    upsert_table(frame(spark, {("a", 40): (99, "m"), ("a", 3): (3, "other")}), table, ["x"])
    after = set(spark.table(table).inputFiles())
    kept = {f for f in before if "2024-02" not in f}
    assert kept <= after and not before <= after
    assert spark.table(table).filter("x = 99").count() == 1 and spark.table(table).count() == 80


@pytest.mark.parametrize("frame_kind", ["rows", "calendar"])
def test_view_texts_state_the_operators(spark, database, frame_kind):
    days = [d for d in range(800) if d % 97 and d % 7 != 3 or d < 200]
    series = frame(spark, {(s, d): (d * 7919 % 101 if d % 50 else 0, "n") for d in days for s in ("a", "b")})
    series = series.withColumn("amount", (F.col("x") * 3 + 1).cast("decimal(18,2)"))
    series.write.saveAsTable(f"{database}.s")
    stored, metrics, keys = spark.table(f"{database}.s"), ["x", "amount"], ["shop"]
    texts = {
        baseline_sql(f"{database}.s", metrics, keys, 3, frame=frame_kind, on_zero="null"):
            rolling_weekday_baseline(stored, metrics, keys, 3, frame=frame_kind, on_zero="null"),
        lag_sql(f"{database}.s", metrics, keys, 357, on_zero="null"):
            lag_variation(stored, metrics, keys, 357, on_zero="null"),
    }
    for sql, operator in texts.items():
        viewed = spark.sql(sql)
        assert sorted(viewed.dtypes) == sorted(operator.dtypes)
        assert sorted(map(str, viewed.select(*operator.columns).collect())) == sorted(map(str, operator.collect()))


def test_views_stay_and_carry_their_comments(spark, database, sf_dir):
    from tideline.plans import loads, settlements

    weekly, yearly = loads.kept_views(spark, sf_dir)
    later = spark.newSession()
    want = {weekly: settlements.weekly_view, yearly: settlements.yearly_view}
    for name, view in want.items():
        described = later.sql(f"DESCRIBE {name}").collect()
        assert all(r.comment for r in described)
        extended = {r.col_name: r.data_type for r in later.sql(f"DESCRIBE EXTENDED {name}").collect()}
        assert "claims no cause" in extended["Comment"] and extended["Type"] == "VIEW"
        expected = view(loads.settled(spark, sf_dir))
        assert later.table(name).dtypes == expected.dtypes
        assert sorted(map(str, later.table(name).collect())) == sorted(map(str, expected.collect()))


def test_view_needs_comments(spark, database):
    with pytest.raises(ValueError, match="no comment for b"):
        create_view(spark, f"{database}.v", "SELECT 1 AS a, 2 AS b", {"a": "a", "b": "b"}, {"a": "one"})
