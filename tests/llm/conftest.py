import pytest
from pyspark.sql import functions as F

from tideline.llm.durable import let_workers_import


@pytest.fixture
def docs(spark):
    """A table like ``documents`` from (doc_id, text) pairs, with columns whose names the operators use themselves."""
    let_workers_import(spark)

    def build(rows, source=lambda i: "s"):
        data = [(i, t, "en", source(i), None if t is None else len(t), "x", 1) for i, t in rows]
        kind = "doc_id long, text string, lang string, source string, n_chars long, row string, key int"
        return spark.createDataFrame(data, kind)

    return build


@pytest.fixture
def rows_of():
    return lambda frame: [tuple(r) for r in frame.collect()]


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("no input"))
