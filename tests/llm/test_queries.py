import pytest

import __spark_entry__ as driver
import corpus_pipeline
from tests.check import compare, oracle
from tideline.llm.durable import written
from tideline.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle(sf_dir)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, connection, sf_dir):
    assert compare(spark, connection, sf_dir, name, QUERIES[name], ORACLES[name]) == []


def test_pipeline_stages(spark, sf_dir):
    """Stages keep the columns, drop what they should and nothing else."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs = written(stage(spark, docs, sf_dir), name)
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert kept[name].columns == kept["documents"].columns
    ids = {n: [r["doc_id"] for r in f.select("doc_id").collect()] for n, f in kept.items()}
    good = [i for i in ids["documents"] if label.get(i) == 1]
    assert len(set(good) - set(ids[names[0]])) <= 0.01 * len(good)
    assert sorted(ids[names[1]]) == sorted(ids[names[0]])
    assert len(ids[names[2]]) == len(set(ids[names[2]])) < len(ids[names[1]])
    assert set(ids[names[3]]) == set(ids[names[2]]) and len(ids[names[3]]) > len(ids[names[2]])
    assert set(ids[names[4]]) == set(ids[names[3]])
