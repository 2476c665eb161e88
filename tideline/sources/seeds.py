"""Window calendars kept as versioned CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.sources.contracts import TableContract


def read_window_seed(spark: SparkSession, path: str, contract: TableContract) -> DataFrame:
    """Read a CSV with a header strictly.

    A bad date, a missing column or a header that differs from the contract
    stops the read. Required columns are not enforced by the reader: check them.
    """
    return (
        spark.read.schema(contract.schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("dateFormat", "yyyy-MM-dd")
        .option("mode", "FAILFAST")
        .csv(path)
    )
