"""Bounded samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAIN = 1_000_000_000


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def sampled(df: DataFrame, doc_id: str, bound: int, rows: int, seed: int) -> DataFrame:
    """About ``bound`` of the ``rows`` rows of ``df``, picked by a hash of the id: the same ones in every run."""
    if rows <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(GRAIN)) < int(GRAIN * bound / rows))
