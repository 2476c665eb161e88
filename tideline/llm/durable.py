"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tideline.session import remove_folder, scratch_path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df``, computed once, written to the shared folder (in folders ``by``) and read back.

    This cuts the lineage at files that survive the loss of any executor.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.partitionBy(*by).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._tideline_path = path
    return found


def discard(df: DataFrame) -> None:
    """Remove a table made by ``written`` that nothing will read any more."""
    remove_folder(df.sparkSession, df._tideline_path)


def let_workers_import(spark: SparkSession) -> None:
    """Let the Python workers of a local session find this package wherever the driver was
    started. On a cluster it is installed or sent with --py-files."""
    if spark.sparkContext.master.startswith("local["):
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
