"""Writing tables: full replacement, upsert by partition, catalog overwrite."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.compare import inline
from tideline.operators.merge import INSERT, KEPT, UPDATE, merge_rows
from tideline.operators.quality import GateError, key_report, require
from tideline.session import remove_folder, scratch_path
from tideline.sources import files
from tideline.sources.contracts import MISSING, MONTH, declaration, enforced

VERSION_PREFIX = "version"
REPORT = "action string, rows bigint"


def _checked_write(write: Callable[[], None], leftover: Callable[[], None]) -> None:
    """Run a write whose plan raises on a missing required value; a refused one leaves nothing."""
    try:
        write()
    except Exception as error:
        leftover()
        if MISSING in str(error):
            found = re.search(rf"{re.escape(MISSING)}: [^\]\n]*", str(error))
            raise GateError(found.group(0) if found else MISSING) from None
        raise


def publish_version(
    df: DataFrame,
    directory: str,
    stamp: str | None = None,
    required: Sequence[str] = (),
    check: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Replace a whole table by writing a new version beside the old ones.

    Readers follow ``read_current`` and see the old or the new content, never an
    empty table in between. Publishing the same content again changes nothing
    for them. The rows are computed once, under a hidden name: a missing ``required``
    value stops the write itself, and ``check`` reports on the written rows. Only what passes
    gets its version name, so what was checked is what readers see.
    """
    spark = df.sparkSession
    name = f"{VERSION_PREFIX}_{stamp or files.stamp_now()}"
    path, hidden = f"{directory}/{name}", f"{directory}/_{name}-{uuid.uuid4().hex}"
    if files.exists(spark, path):
        raise FileExistsError(f"{path} already exists")
    drop = lambda: remove_folder(spark, hidden)
    _checked_write(lambda: enforced(df, required).write.mode("errorifexists").parquet(hidden), drop)
    if check is not None:
        try:
            require(check(spark.read.schema(df.schema).parquet(hidden)))
        except GateError:
            drop()
            raise
    files.move(spark, hidden, path)
    return path


def read_current(spark: SparkSession, directory: str) -> DataFrame:
    """The newest complete version."""
    versions = files.stamped(spark, directory, VERSION_PREFIX)
    if not versions:
        raise FileNotFoundError(f"no published version in {directory}")
    return spark.read.parquet(f"{directory}/{versions[-1]}")


def overwrite_table(df: DataFrame, table: str) -> None:
    """Replace the rows of a catalog table and keep its declaration.

    Rows that lack a value the declaration requires are refused. The new rows are first
    written to the shared folder: Spark empties a table before it fills it, so a batch
    that fails half-way must not get that far.
    """
    spark = df.sparkSession
    staged = scratch_path(spark, "overwrite")
    drop = lambda: remove_folder(spark, staged)
    _checked_write(lambda: enforced(df, declaration(spark, table).required).write.parquet(staged), drop)
    spark.read.schema(df.schema).parquet(staged).write.insertInto(table, overwrite=True)
    drop()


def write_daily(df: DataFrame, path: str, day: str = "day", required: Sequence[str] = ()) -> None:
    """A new daily table, one directory per month; the day and ``required`` columns must be filled.

    Rebalancing by month gives few files per month and still splits a month that
    is too large for one task. The table appears when it is complete.
    """
    spark = df.sparkSession
    if files.exists(spark, path):
        raise FileExistsError(f"{path} already exists")
    parent, name = path.rstrip("/").rsplit("/", 1)
    hidden = f"{parent}/_{name}-{uuid.uuid4().hex}"
    rows = _placed(enforced(df, [day, *required]), day).hint("rebalance", MONTH)
    _checked_write(
        lambda: rows.write.mode("errorifexists").partitionBy(MONTH).parquet(hidden),
        lambda: remove_folder(spark, hidden),
    )
    files.move(spark, hidden, path)


def read_daily(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table written by ``write_daily``; ``schema`` is that of its rows."""
    return spark.read.schema(T.StructType([*schema.fields]).add(MONTH, "string")).parquet(path)


def _placed(df: DataFrame, day: str) -> DataFrame:
    if MONTH in df.columns:
        raise GateError(f"the column name {MONTH} is taken by the table's directories")
    return df.withColumn(MONTH, F.date_format(day, "yyyy-MM"))


def _in_months(df: DataFrame, months: DataFrame) -> DataFrame:
    """Rows in any of the months, at most as many as the calendar has: literals prune directories."""
    names = sorted(r[MONTH] for r in months.select(MONTH).collect())
    return df.filter(F.col(MONTH).isin(names))


def _same_columns(stored: T.StructType, batch: T.StructType) -> None:
    kinds = [{f.name: f.dataType.simpleString() for f in s if f.name != MONTH} for s in (stored, batch)]
    if kinds[0] != kinds[1]:
        differ = sorted(set(kinds[0].items()) ^ set(kinds[1].items()))
        raise GateError(f"stored and new rows differ in their columns: {differ}")


def upsert_daily(
    spark: SparkSession,
    batch: DataFrame,
    path: str,
    keys: Sequence[str],
    compare: Sequence[str],
    day: str = "day",
    check: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Upsert a batch into a table written by ``write_daily``; returns how many rows of the
    batch were inserted, updated or found unchanged.

    Only months the batch touches are read, and of those only months with an
    insert or an update are rewritten; everything else stays as it is. ``day`` must be
    among the keys, as a row that moves to another month would not meet its old self, and
    both sides must have the same columns and types; otherwise nothing is written.

    The batch is computed once and written to the shared folder, and so are the
    merged months. The checks of keys, ``check`` (a report on the staged rows), the counts and the
    rewrite read those copies: what is checked is what is stored, none of it
    depends on files the rewrite replaces, and a lost executor costs a task, not
    the result. Running the same batch again finishes a rewrite cut short.
    """
    exists = files.exists(spark, path)
    stored = spark.read.parquet(path).schema if exists else batch.schema
    rows = T.StructType([f for f in stored if f.name != MONTH])

    def replace(changed: DataFrame) -> None:
        if not exists:
            write_daily(changed.drop(MONTH), path, day)
            return
        writer = changed.hint("rebalance", MONTH).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)

    current = read_daily(spark, path, rows) if exists else None
    return _upsert(batch, rows, current, replace, keys, compare, day, (), check)


def upsert_table(
    batch: DataFrame,
    table: str,
    compare: Sequence[str],
    check: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``upsert_daily`` into a catalog table declared by ``TableContract.create(..., by_month=...)``.

    Keys, required columns and the day come from the declaration, by which the batch is
    read: a missing column or value, a repeated key or another type is refused and nothing written.
    Changed months replace their partitions; others, and the declaration, stay.
    """
    spark = batch.sparkSession
    declared = declaration(spark, table)
    if not declared.day:
        raise ValueError(f"{table} is not declared by month")
    stored = spark.table(table)
    rows = T.StructType([f for f in stored.schema if f.name != MONTH])

    def replace(changed: DataFrame) -> None:
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")
        try:
            changed.select(*stored.columns).hint("rebalance", MONTH).write.insertInto(table, overwrite=True)
        finally:
            spark.conf.set(mode, before)

    return _upsert(batch, rows, stored, replace, declared.key, compare, declared.day, declared.required, check)


def _upsert(
    batch: DataFrame,
    rows: T.StructType,
    stored: DataFrame | None,
    replace: Callable[[DataFrame], None],
    keys: Sequence[str],
    compare: Sequence[str],
    day: str,
    required: Sequence[str],
    check: Callable[[DataFrame], DataFrame] | None,
) -> DataFrame:
    spark = batch.sparkSession
    if day not in keys:
        raise ValueError(f"{day} must be one of the keys")
    _same_columns(rows, batch.schema)
    staged_path, merged_path = scratch_path(spark, "batch"), scratch_path(spark, "merged")

    def drop() -> None:
        for path in (staged_path, merged_path):
            remove_folder(spark, path)

    placed = _placed(enforced(batch.select(*rows.names), [*keys, *required]), day)
    _checked_write(lambda: placed.write.parquet(staged_path), drop)
    try:
        staged = read_daily(spark, staged_path, rows)
        require(check(staged.drop(MONTH)) if check else key_report(staged, keys))
        if stored is None:
            replace(staged)
            return inline(spark, [(INSERT, staged.count())], REPORT)
        touched = _in_months(stored, staged.groupBy(MONTH).agg(F.count(F.lit(1))))
        merged = merge_rows(touched, staged, keys, compare)
        merged.write.parquet(merged_path)
        merged = spark.read.schema(merged.schema).parquet(merged_path)
        counts = merged.filter(F.col("action") != KEPT).groupBy(MONTH, "action").count().collect()
        changed = sorted({r[MONTH] for r in counts if r["action"] in (INSERT, UPDATE)})
        if changed:
            replace(merged.drop("action").filter(F.col(MONTH).isin(changed)))
        report: Counter[str] = Counter()
        for r in counts:
            report[r["action"]] += r["count"]
        return inline(spark, sorted(report.items()), REPORT)
    finally:
        drop()
