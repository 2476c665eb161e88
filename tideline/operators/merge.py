"""Keyed upsert with change detection, as a query."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What happened to a row.
INSERT, UPDATE, UNCHANGED, KEPT = "insert", "update", "unchanged", "kept"


def merge_rows(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], compare: Sequence[str]
) -> DataFrame:
    """The new state of ``target`` after an upsert, with an ``action`` per row.

    Matched rows are replaced only if one of the ``compare`` columns differs,
    NULL being equal to NULL. Rows the batch does not mention are kept. Both
    sides must be unique on ``keys`` (check the batch first).
    """
    payload = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*payload).alias("_old"))
    new = batch.select(*keys, F.struct(*payload).alias("_new"))
    same = reduce(and_, (F.col("_old")[c].eqNullSafe(F.col("_new")[c]) for c in compare))
    action = (
        F.when(F.col("_old").isNull(), INSERT)
        .when(F.col("_new").isNull(), KEPT)
        .when(same, UNCHANGED)
        .otherwise(UPDATE)
    )
    merged = old.join(new, list(keys), "full_outer").withColumn("action", action)
    row = F.when(F.col("action").isin(INSERT, UPDATE), F.col("_new")).otherwise(F.col("_old"))
    return merged.withColumn("_row", row).select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in target.columns],
        "action",
    )


def merge_report(merged: DataFrame) -> DataFrame:
    """Rows per action."""
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("rows"))
