"""Raw JSON snapshots: landing, choosing the newest, reading, profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.quality import GateError
from tideline.session import remove_folder
from tideline.sources import files
from tideline.sources.contracts import EnvelopeLayout


def land_snapshot(
    rows: DataFrame,
    directory: str,
    prefix: str,
    layout: EnvelopeLayout,
    stamp: str | None = None,
) -> str:
    """Write one extraction as a new stamped entry and return its path.

    Existing snapshots are never touched, and nothing appears for a batch that
    lacks a declared field or has no rows. ``rows`` hold the raw fields of the
    layout and are computed once: they are written under a hidden name, looked
    at, and then given their stamp. Each row gets an envelope line of its own,
    so nothing is gathered or shuffled and a reader can split the files.
    """
    spark = rows.sparkSession
    fields = layout.row_schema.fieldNames()
    absent = [f for f in fields if f not in rows.columns]
    if absent:
        raise GateError(f"the batch lacks {', '.join(absent)}")
    path = f"{directory}/{prefix}_{stamp or files.stamp_now()}"
    if files.exists(spark, path):
        raise FileExistsError(f"{path} already exists")
    hidden = f"{directory}/_{prefix}-{uuid.uuid4().hex}"
    envelopes = rows.select(F.array(F.struct(*fields)).alias(layout.array))
    envelopes.write.mode("errorifexists").option("ignoreNullFields", "false").json(hidden)
    if spark.read.text(f"{hidden}/part-*").isEmpty():
        remove_folder(spark, hidden)
        raise GateError("the batch is empty")
    files.move(spark, hidden, path)
    return path


def latest_snapshot(spark: SparkSession, directory: str, prefix: str) -> str:
    """Path of the newest snapshot: the last by name, which is the last in time."""
    found = files.stamped(spark, directory, prefix) + files.stamped(
        spark, directory, prefix, ".json"
    )
    if not found:
        raise FileNotFoundError(f"no snapshot {prefix}_* in {directory}")
    return f"{directory}/{max(found)}"


def scan_snapshots(
    spark: SparkSession, path: str | list[str], layout: EnvelopeLayout, mode: str = "FAILFAST"
) -> DataFrame:
    """Rows of one or many snapshots, raw fields plus the ``snapshot`` they came from.

    A landed directory holds one envelope per line and is split like any text;
    a single ``.json`` file is one document.
    """
    paths = [path] if isinstance(path, str) else list(path)
    document = {p.endswith(".json") for p in paths}
    if len(document) != 1:
        raise ValueError("read single documents and landed directories separately")
    name = F.regexp_extract("_metadata.file_path", f"_({files.STAMP_PATTERN})", 1)
    return (
        spark.read.schema(layout.schema)
        .option("mode", mode)
        .option("multiLine", document.pop())
        .json(paths)
        .select(F.explode(layout.array).alias("_row"), name.alias("snapshot"))
        .select("_row.*", "snapshot")
    )


def typed_rows(raw: DataFrame, layout: EnvelopeLayout) -> DataFrame:
    """Raw fields to dated, renamed, unit-converted columns."""
    day = F.to_date(layout.date_field, layout.date_format).alias(layout.date_column)
    columns = []
    for f in layout.fields:
        value = F.col(f.source) if f.factor == 1 else F.col(f.source) * f.factor
        columns.append(value.cast(f.column_type or f.type).alias(f.column))
    return raw.select(day, *columns)


def ingest_snapshot(
    spark: SparkSession, directory: str, prefix: str, layout: EnvelopeLayout
) -> DataFrame:
    """The newest snapshot as a typed series."""
    newest = latest_snapshot(spark, directory, prefix)
    return typed_rows(scan_snapshots(spark, newest, layout), layout)


def snapshot_profile(raw: DataFrame, layout: EnvelopeLayout, cap: int = 10_000) -> DataFrame:
    """Per snapshot: rows, distinct dates, first and last date, page-cap warning."""
    per_date = raw.groupBy("snapshot", layout.date_field).agg(F.count(F.lit(1)).alias("_n"))
    return per_date.groupBy("snapshot").agg(
        F.sum("_n").alias("rows"),
        F.count(layout.date_field).alias("distinct_dates"),
        F.min(layout.date_field).alias("first_date"),
        F.max(layout.date_field).alias("last_date"),
        (F.sum("_n") >= cap).alias("maybe_truncated"),
    )
