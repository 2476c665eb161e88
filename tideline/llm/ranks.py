"""Positions in a total order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.durable import written

_PLACE_BITS = 33  # of the numbers that monotonically_increasing_id gives within a partition


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df``, a table that can be read twice, with ``name``: 1, 2, 3 ... in the order ``by``.

    Rows are dealt by ranges of ``by``, sorted inside each and numbered there; the sizes
    of the ranges, one row per partition, are summed up and added. Rows that ``by`` leaves
    equal are split over partitions by a random number.
    """
    dealt = df.withColumn("_tie", F.rand(3)).repartitionByRange(*by, F.col("_tie")).sortWithinPartitions(*by, F.col("_tie"))
    placed = written(dealt.withColumn("_place", F.monotonically_increasing_id()).drop("_tie"), "placed")
    part = F.shiftright("_place", _PLACE_BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        placed.select("*", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + place + 1)
        .drop("_part", "_place", "_start")
    )
