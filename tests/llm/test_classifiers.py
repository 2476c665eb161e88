import numpy as np
import pytest

from tideline.llm import cotraining, toxicity
from tideline.llm.sampling import fold


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture
def corpus(docs, labels):
    rng = np.random.default_rng(6)
    rows, marks = [], []
    for i in range(600):
        text, toxic, good = prose(rng, 60), i % 8 == 0, i % 5 != 0
        if toxic:
            text += " You Moronzzz, vile " + prose(rng, 5)
        if not good:
            text = " ".join(f"{w.upper()}!!" for w in text.split()[:8] * 6) + (" moronzzz" if toxic else "")
        rows.append((i, text))
        if i % 3:
            marks.append((i, int(good), int(toxic)))
    rows += [(900, None), (901, ""), (None, "no id"), (902, "moronzzz " * 30_000), (5, rows[5][1])]
    marks += [(5, None, None), (None, 1, 1), (7777, 1, 1), (8, 1, 1)]
    return rows, docs(rows), labels(marks)


def test_toxicity_on_the_held_out_fold(corpus, rows_of):
    rows, docs, labels = corpus
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    truth = [r["doc_id"] % 8 == 0 for r in held]
    right = [bool(r["predicted"]) == t for r, t in zip(held, truth)]
    assert np.mean(right) > 0.97
    by_id = {r["doc_id"]: r for r in found}
    assert all(0 <= r["score"] <= 1 for r in found) and by_id[900]["score"] == by_id[901]["score"] < 0.5
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_held_out_labels_teach_nothing(corpus):
    _, docs, labels = corpus
    turned = labels.withColumn("toxic", __import__("pyspark").sql.functions.when(fold("doc_id", 3) == 1, 1 - labels.toxic).otherwise(labels.toxic))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a.features == b.features).all() and np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def test_toxicity_without_examples_or_texts(docs, labels):
    frame = docs([(1, "a"), (2, None)])
    assert [r["predicted"] for r in toxicity.toxicity(frame, labels([])).collect()] == [0, 0]
    assert toxicity.toxicity(docs([]), labels([(1, 1, 1)])).collect() == []


def test_risk_is_corrected_by_the_prior():
    rng = np.random.default_rng(0)
    noise = lambda: rng.choice(2_000, 30, replace=False) + 10
    draw = lambda toxic: np.unique(np.append(noise(), 1 if toxic else 2)).astype(np.uint32)
    model = toxicity.fit_nnpu([draw(True) for _ in range(150)], [draw(k % 5 == 0) for k in range(1_500)], 0.2)
    score = lambda x: 1 / (1 + np.exp(-(model.bias + model.weights[np.isin(model.features, x)].sum())))
    assert np.mean([score(draw(True)) for _ in range(50)]) > 0.8 and np.mean([score(draw(False)) for _ in range(50)]) < 0.2


def test_quality_of_rows_without_labels(corpus):
    rows, docs, labels = corpus
    model = cotraining.train(docs, labels)
    found = cotraining.classify(docs, model).collect()
    assert len(found) == len(rows)
    unlabelled = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 3 == 0]
    assert np.mean([r["accepted"] == (r["doc_id"] % 5 != 0) for r in unlabelled]) > 0.97
    kept = cotraining.accepted(docs, model)
    assert kept.schema == docs.schema
    key = lambda r: repr((r["doc_id"], r["text"]))
    assert len(kept.collect()) == sum(r["accepted"] for r in found) and len({key(r) for r in kept.collect()}) > 400


def test_views_teach_each_other():
    """With a handful of labels, pseudo-labels of the content let the metadata view learn its rule."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 3_000)
    values = rng.normal(0, 1, (3_000, cotraining.MEASURES))
    values[:, 0] += 8 * y
    buckets = np.stack([y, np.full(3_000, 9), np.full(3_000, 10), 20 + y], 1)
    labels = np.where(np.arange(3_000) < 240, y, -1)
    model = cotraining.cotrain(values, buckets, labels)
    content, metadata, both = model.scores(values, buckets)
    for score in (content, metadata, both):
        assert np.mean((score > 0) == y) > 0.95


def test_quality_without_labels_or_rows(docs, labels):
    frame = docs([(1, "a b"), (2, None)])
    model = cotraining.train(frame, labels([]))
    assert [r["accepted"] for r in cotraining.classify(frame, model).collect()] == [True, True]
    assert cotraining.classify(docs([]), model).collect() == []
    cotraining.train(docs([]), labels([(1, 1, 0)]))


def test_absent_metadata(spark, labels):
    frame = spark.createDataFrame([(1, "good words"), (2, "x")], "doc_id long, text string")
    assert cotraining.accepted(frame, cotraining.train(frame, labels([(1, 1, 0), (2, 0, 0)]))).columns == ["doc_id", "text"]


def test_labelled_and_other_rows_are_one_sample(docs, labels):
    """Both sides of the sample have the same columns, so labels and texts without one train together."""
    frame = docs([(i, "good plain words here" if i % 2 else "BAD!! BAD!! BAD!!") for i in range(60)])
    model = cotraining.train(frame, labels([(i, i % 2, 0) for i in range(40)]))
    assert all(r["accepted"] == bool(r["doc_id"] % 2) for r in cotraining.classify(frame, model).collect())


def test_a_toxic_passage_in_a_long_text_counts(corpus, docs):
    rows, frame, labels = corpus
    clean = prose(np.random.default_rng(8), 20_000)
    passage = clean[:60_000] + " You Moronzzz, vile " + clean[60_000:]
    model = toxicity.train(frame, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs([(1, clean), (2, passage)]), model).collect()}
    assert found[2] > 0.7 > found[1]
