"""Putting two results next to each other."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def inline(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small literal table, such as figures taken from a publication.

    Its rows travel with the plan; read larger tables from a source.
    """
    fields = T.StructType.fromDDL(schema).fields
    literals = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    if not literals:
        return spark.createDataFrame([], schema)
    # Literals stay in the JVM; rows made from Python objects would need a Python stage.
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*literals)))


def reconcile(calculated: DataFrame, published: DataFrame, on: Sequence[str]) -> DataFrame:
    """Published figures beside calculated ones, for the rows both have.

    A literal table from ``inline`` is small enough for Spark to send it to the
    executors unasked; a larger one is joined as its measured size allows.
    """
    return calculated.join(published, list(on), "inner")


def side_by_side(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Two sets of variations for the same days, one row per day that both have."""
    return left.join(right, list(on), "inner")
