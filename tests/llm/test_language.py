from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import language
from tideline.llm.language import build, folded, identify, phrases

WORDS = {"aa": ["bato", "kemu", "risá", "dolen", "paf"], "bb": ["strelk", "vzorn", "plyčt", "grudm", "skrab"]}


def greedy(text: bytes, learned: bytes) -> int:
    """phrases by searching the learned text for ever longer pieces"""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in learned and text[at : at + size] in learned:
            size += 1
        at, n = at + size, n + 1
    return n


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n)).capitalize()


@pytest.fixture
def labelled(spark, docs):
    docs([])  # lets the workers import

    def build(rows):
        return spark.createDataFrame([(i, t, l, 1, "c") for i, t, l in rows], "doc_id long, text string, lang string, h int, piece string")

    return build


def test_phrases_against_search():
    rng = np.random.default_rng(1)
    learned = [rng.choice(list(b"abcd"), n).astype(np.uint8).tobytes() for n in (50, 400, 3)]
    texts = ["", " ", "a", "zz", *("".join(rng.choice(list("abcde "), n)) for n in (3, 40, 255, 256, 257, 900))]
    data, bounds = folded(pa.array(texts, pa.large_string()))
    found = phrases(data, bounds, build(tuple(learned)), block=1 << 20)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        assert found[i].tolist() == [greedy(data[a:b].tobytes(), x) for x in learned]
    blocks = phrases(data, bounds, build(tuple(learned)), block=64)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        assert blocks[i].tolist() == [sum(greedy(data[k : min(k + 64, b)].tobytes(), x) for k in range(a, b, 64)) for x in learned]


def test_folding():
    data, bounds = folded(pa.array(["Ab, c!É9", None, "...", "x"], pa.large_string()).fill_null(""))
    assert [data[a:b].tobytes().decode().strip() for a, b in zip(bounds, bounds[1:])] == ["ab c é", "", "", "x"]


def test_held_out_texts(labelled):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, l, int(rng.integers(1, 60))), l if i % 7 else None) for i, l in enumerate(rng.choice(["aa", "bb"], 300))]
    truth = {i: "aa" if t.lower().split()[0] in WORDS["aa"] else "bb" for i, t, _ in rows}
    found = identify(labelled(rows)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == truth
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)


def test_only_text_and_learned_labels_count(labelled):
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, "ab"[i % 2] * 2, 20), "ab"[i % 2] * 2) for i in range(200)]
    held = lambda i: crc32(str(i).encode()) % 4 == 2
    lied = [(i, t, "cc" if held(i) else l) for i, t, l in rows]
    assert sorted(map(tuple, identify(labelled(rows)).collect())) == sorted(map(tuple, identify(labelled(lied)).collect()))


def test_odd_rows(labelled):
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng, "ab"[i % 2] * 2, 20), "ab"[i % 2] * 2) for i in range(60)]
    odd = [(100, None, "aa"), (101, "", "aa"), (102, "12 ?! ٣", "bb"), (103, "ж", "aa"), (None, prose(rng, "aa", 9), None),
           (104, prose(rng, "bb", 60_000), None), (104, prose(rng, "bb", 5), None)]
    found = [tuple(r) for r in identify(labelled(rows + odd)).filter("doc_id >= 100 or doc_id is null").collect()]
    pred = sorted(((i, l) for i, _, l, _ in found), key=repr)
    assert [p for p in pred if p[0] != 103] == [(100, "und"), (101, "und"), (102, "und"), (104, "bb"), (104, "bb"), (None, "aa")]
    assert dict(pred)[103] in ("aa", "bb") and all(s == 0 for i, _, l, s in found if l == "und")


def test_copies_do_not_crowd_out_a_sample(labelled):
    rng = np.random.default_rng(5)
    rows = [(i, "Bato bato bato bato. " * 20, "aa") for i in range(400)]
    rows += [(i, prose(rng, "aa", 200), "aa") for i in range(400, 460)] + [(i, prose(rng, "bb", 200), "bb") for i in range(460, 520)]
    learned = language.learn(labelled(rows), "text", "doc_id", "lang", 100, 30)
    parts = {k: v.split(bytes([0])) for k, v in learned.items()}
    assert list(parts) == ["aa", "bb"] and all(15 < len(p) == len(set(p)) <= 30 for p in parts.values())


def test_nothing_to_learn_from(labelled):
    assert identify(labelled([])).collect() == []
    rows = [(i, "some words", None) for i in range(9)]
    assert {(r["lang_pred"], r["score"]) for r in identify(labelled(rows)).collect()} == {("und", 0.0)}


def test_accuracy_on_held_out_documents(spark, sf_dir, docs):
    docs([])
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(known).join(known.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
