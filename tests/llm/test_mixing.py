import math
from collections import Counter, defaultdict

import pytest

from tideline.llm.durable import written
from tideline.llm.mixing import mixture, realise, token_table


def mix(docs, rows, source, **how):
    frame = docs(rows, source)
    tokens = written(token_table(frame), "tokens")
    found = mixture(tokens, seed=3, **how)
    return found, {r["source"]: r for r in found.sources.collect()}, realise(frame, found, seed=3).collect()


def corpus(sizes):
    rows, of = [], {}
    for s, count in sizes.items():
        for k in range(count):
            i = len(rows)
            rows.append((i, " ".join(["w"] * (1 + (k * 7) % 5))))
            of[i] = s
    return rows, of.get


def test_every_document_and_the_repetition_limit(docs):
    rows, source = corpus({"a": 300, "b": 40, "c": 25, None: 10})
    found, sources, picked = mix(docs, rows, source, max_repeats=3.0)
    times = Counter(r["row"]["doc_id"] for r in picked)
    assert set(times) == {i for i, _ in rows}
    repeats = {s: r["budget"] / r["tokens"] for s, r in sources.items()}
    assert max(repeats.values()) <= 3.0 + 1e-2 and max(repeats.values()) > 2.9
    assert sum(r["weight"] for r in sources.values()) == pytest.approx(1)


def test_budgets_are_met_by_the_order_of_each_block(docs):
    rows, source = corpus({"a": 200, "b": 50})
    size = {i: len(t.split()) for i, t in rows}
    _, sources, picked = mix(docs, rows, source, entropy=0.66)
    blocks = defaultdict(list)
    for r in picked:
        blocks[r["row"]["source"], r["block"]].append((r["place"], r["row"]["doc_id"]))
    for s, r in sources.items():
        own = {i for i, _ in rows if source(i) == s}
        spent = 0
        for b in range(r["blocks"]):
            assert {i for _, i in blocks[s, b]} == own
            spent += r["tokens"]
        last = blocks.get((s, r["blocks"]), [])
        spent += sum(size[i] for _, i in last)
        assert r["budget"] - 5 < spent <= r["budget"]
        if last:  # a prefix of the permutation
            from hashlib import md5

            place = lambda i: int(md5(f"3:{r['blocks']}:{i}".encode()).hexdigest()[:15], 16)
            assert {i for _, i in last} == set(sorted(own, key=place)[: len(last)])


def test_entropy_is_met_by_bisection(docs):
    rows, source = corpus({"a": 400, "b": 50, "c": 20})
    found, sources, _ = mix(docs, rows, source, entropy=0.9)
    h = -sum(r["weight"] * math.log(r["weight"]) for r in sources.values())
    assert h == pytest.approx(0.9, abs=1e-5)


def test_odd_rows(docs):
    found, sources, picked = mix(docs, [(1, ""), (2, None), (None, "a b"), (3, "a"), (3, "a")], lambda i: "e" if i in (1, 2) else "f", max_repeats=2)
    assert sources["e"]["weight"] == 0 and sources["e"]["blocks"] == 1
    assert Counter(r["row"]["doc_id"] for r in picked) == {1: 1, 2: 1, None: 1, 3: 2}
    assert mix(docs, [], lambda i: "s", max_repeats=2)[2] == []
    with pytest.raises(ValueError):
        mix(docs, [(1, "a")], lambda i: "s")
