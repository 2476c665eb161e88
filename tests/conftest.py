import os
from datetime import date, timedelta
from pathlib import Path

import pytest

from tideline.session import local_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tideline-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).exists():
        pytest.skip(f"no test tables in {SF_DIR}")
    return SF_DIR


@pytest.fixture
def series(spark):
    """A series (day, x) from consecutive values; positions in ``gaps`` are left out."""

    def build(values, first=date(2024, 1, 1), kind="bigint", gaps=()):
        rows = [
            (first + timedelta(days=i), None if v is None else str(v))
            for i, v in enumerate(values)
            if i not in gaps
        ]
        text = spark.createDataFrame(rows, "day date, x string")
        return text.select("day", text.x.cast(kind).alias("x"))

    return build
