"""Names of finished outputs in a shared file system, through Spark's own Hadoop client."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import SparkSession

# A UTC stamp whose alphabetical order is its order in time.
STAMP_FORMAT = "%Y-%m-%dT%H%M%SZ"
STAMP_PATTERN = r"\d{4}-\d{2}-\d{2}T\d{6}Z"


def stamp_now() -> str:
    return datetime.now(timezone.utc).strftime(STAMP_FORMAT)


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = _hadoop_path(spark, path)
    return system.exists(hadoop)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a finished output its final name; an existing name is never reused."""
    if exists(spark, target):
        raise FileExistsError(f"{target} already exists")
    hadoop, system = _hadoop_path(spark, source)
    if not system.rename(hadoop, _hadoop_path(spark, target)[0]):
        raise OSError(f"could not move {source} to {target}")


def stamped(spark: SparkSession, directory: str, prefix: str, suffix: str = "") -> list[str]:
    """Stamped entries of a directory, oldest first.

    Plain files count as they are. Directories count once Spark has marked them
    complete, so an output that is still being written is never picked.
    """
    hadoop, system = _hadoop_path(spark, directory)
    if not system.exists(hadoop):
        return []
    wanted = re.compile(f"{re.escape(prefix)}_{STAMP_PATTERN}{re.escape(suffix)}")
    names = []
    for status in system.listStatus(hadoop):
        name = status.getPath().getName()
        if not wanted.fullmatch(name):
            continue
        if status.isDirectory() and not exists(spark, f"{directory}/{name}/_SUCCESS"):
            continue
        names.append(name)
    return sorted(names)
