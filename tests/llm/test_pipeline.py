"""Pipeline stages on odd tables: nothing crashes, nothing that is no copy gets lost."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import STAGES, near_dedup, run
from tideline.llm.durable import written

STAGE = dict(STAGES)
PROSE = "The first of many words that follow one another in this text, number"


@pytest.fixture
def folder(spark, docs, tmp_path):
    """A folder of tables; documents with columns whose names the operators use themselves."""

    def build(rows, labels=()):
        docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return build


ODD = (
    [(i, f"{PROSE} {i} " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)]
    + [(100, None), (101, ""), (102, " \n"), (None, PROSE), (None, None), (103, "x" * 300_000)]
    + [(104, "a b c d e f g\nsame line here")] * 3
    + [(105, "a b c d e f g\nsame line here"), (105, "another text with words of its own, not a copy")]
)


def test_a_text_stays_that_shares_its_id_with_a_copy(spark, docs):
    one, two = "first text with quite a few words", "second text with other words in it"
    found = near_dedup(spark, docs([(1, one), (3, one), (3, two)]), "")
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == [(1, one), (3, two)]


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows_through_all_stages(spark, folder, labelled):
    sf_dir = folder(ODD, [(i, i % 2, 0) for i in range(40)] if labelled else [])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    texts = {"documents": sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)}
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if name != STAGES[-1][0]:
            assert docs.columns == columns
            texts[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert set(texts["quality_classifier"]) <= set(texts["documents"])
    assert len(texts["line_dedup"]) == len(texts["quality_classifier"])
    assert set(texts["minhash"]) <= set(texts["line_dedup"])
    assert {i for i, _ in texts["mix_sources"]} == {i for i, _ in texts["minhash"]}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {i for i, _ in texts["mix_sources"]}


@pytest.mark.parametrize("name", [n for n, _ in STAGES])
def test_empty_table(spark, folder, name):
    sf_dir = folder([])
    found = STAGE[name](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert found.collect() == []


def test_run_on_nothing(spark, folder):
    assert run(spark, folder([])).collect() == []


def test_stage_outcomes_against_plain_python(spark, docs):
    """Line dedup and near dedup, one after the other, on small texts."""
    rows = [(i, f"shared line of them all\nown line number {i}\n{PROSE} {i % 4}") for i in range(12)]
    seen, want = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        want[i] = "\n".join(l for l in lines if l.lower().strip() not in seen)
        seen |= {l.lower().strip() for l in lines}
    frame = STAGE["line_dedup"](spark, docs(rows), "")
    assert {r["doc_id"]: r["text"] for r in frame.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in frame.collect())
    copies = [(i, " ".join(f"t{i % 3}w{k}" for k in range(20 + i // 9))) for i in range(12)]
    kept = near_dedup(spark, docs(copies), "").select("doc_id")
    assert sorted(r[0] for r in kept.collect()) == [0, 1, 2]


def test_missing_packages_leave_the_rest(monkeypatch):
    import __spark_entry__ as driver

    def broken(name):
        def load(module):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        return load

    for absent in ("public_tokenizers", "zstandard", "tideline.llm", "corpus_pipeline"):
        monkeypatch.setattr(driver, "import_module", broken(absent))
        found = driver.queries()
        assert "rolling_baseline" in found and "pipeline" not in found
        assert "rolling_baseline" in driver.oracle_sql()
    monkeypatch.setattr(driver, "import_module", broken("tideline.operators.series"))
    with pytest.raises(ModuleNotFoundError):
        driver.queries()
