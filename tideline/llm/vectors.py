"""Vectors in shards, and blocks of queries against them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_BLOCK = 32_768  # queries that one task holds at a time


def usable(embeddings: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>) of rows with an id and a vector of finite components."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), bad.alias("bad")).filter(
        "vec_id IS NOT NULL AND v IS NOT NULL AND NOT bad"
    ).select("vec_id", "v")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = (
        column.flatten().to_numpy(zero_copy_only=False)
    )
    return out


def search_shards(
    data: DataFrame, queries: DataFrame, n_queries: int, keys: list[str], search: Callable, best: int
) -> DataFrame:
    """(query_id, rank, vec_id, score) from every pair of a shard and a block of queries.

    ``search(data table, query table)`` gives the best rows of one shard. Data rows are in
    one shard each; they meet the queries in blocks of QUERY_BLOCK, so a task holds one shard
    and one block whatever the number of queries. Per query and shard at most ``best``
    rows remain to be ranked.
    """
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    left = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    found = left.groupBy(*keys, "block").cogroup(right.groupBy(*keys, "block")).applyInArrow(
        search, "query_id long, vec_id long, score double"
    )
    rank: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= best).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
