import math
import re
from collections import Counter

import numpy as np
import pytest

from tideline.llm import lexical
from tideline.llm.lexical import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(rows, items, best=50):
    held = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // total if total else 0
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(found[:best], 1)]
    return sorted(out, key=repr)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, doc_id int")


def corpus(rng, n, vocabulary=400):
    weights = 1 / np.arange(1, vocabulary + 1)
    words = np.array([f"W{k}" for k in range(vocabulary - 2)] + ["É", "ñandú"])
    return [(int(i), " ".join(rng.choice(words, rng.integers(0, 120), p=weights / weights.sum()))) for i in rng.permutation(n)]


@pytest.mark.parametrize("best, block", [(50, 1 << 18), (3, 40)])
def test_against_brute_force(docs, items, rows_of, best, block):
    rng = np.random.default_rng(12)
    rows = corpus(rng, 700) + [(5000, None), (5001, ""), (5002, "w1-w2_w3\x00W4"), (5003, "w7 w9 " * 60_000)]
    asked = corpus(rng, 9) + [(50, None), (51, "?"), (52, "nowhere"), (53, "w0 w0 W0"), (None, "w3 w200")]
    found = lexical_search(docs(rows).repartition(5), items(asked), best=best, block_terms=block)
    assert sorted(rows_of(found), key=repr) == brute(rows, asked, best)


def test_ties_repeats_and_null_ids(docs, items, rows_of):
    rows = [(4, "a b c")] * 3 + [(None, "a b c")] * 2 + [(2, "a b c"), (1, "a x y"), (3, "z z z")]
    asked = [(1, "a b"), (2, "c")]
    for best in (2, 5, 50):
        assert sorted(rows_of(lexical_search(docs(rows), items(asked), best=best)), key=repr) == brute(rows, asked, best)


def test_nothing(docs, items, rows_of):
    assert rows_of(lexical_search(docs([]), items([(1, "a")]))) == []
    assert rows_of(lexical_search(docs([(1, "a")]), items([]))) == []
    assert rows_of(lexical_search(docs([(1, None)]), items([(1, "a")]))) == []


def test_bounds_hold_and_spare_work(monkeypatch):
    """No bound is below its exact score, and with floors most pairs are never scored."""
    import pyarrow as pa

    from tideline.llm.words import slices

    rng = np.random.default_rng(4)
    texts = [t for _, t in corpus(rng, 2_000, 5_000)]
    [run] = slices(pa.array(texts), outside=lexical._OUTSIDE)
    held = lexical.document_terms(run)
    [asked] = slices(pa.array([t for _, t in corpus(rng, 40, 5_000) if t]), outside=lexical._OUTSIDE)
    wanted = lexical.document_terms(asked)
    block = lexical.make_block(pa.array(range(len(asked.bounds) - 1)), np.split(wanted.hashes, np.flatnonzero(np.diff(wanted.owners)) + 1))
    holders = np.bincount(lexical.asked(block, held)[1], minlength=len(block.terms))
    weights = np.floor(1000 * np.log((2 * len(texts) + 2) / (2 * holders + 1))).astype(int)
    measure = lexical.Measure(len(texts), int(held.lengths.sum()), weights)
    impacts = lexical._impacts(held, measure)
    every = np.arange(len(texts))
    bounds = lexical.Sketches(held, impacts).bounds(block, weights)
    exact = lexical.Exact(block, weights, held, impacts)
    d, q = (x.ravel() for x in np.meshgrid(every, np.arange(len(block.items)), indexing="ij"))
    scores = exact.scores(d, q).reshape(bounds.shape)
    assert (bounds >= scores).all() and bounds.mean() < 2 * scores.mean()

    scored = []
    plain = lexical.Exact.scores
    monkeypatch.setattr(lexical.Exact, "scores", lambda self, d, q: scored.append(len(d)) or plain(self, d, q))
    leaders = lexical.Leaders(np.sort(scores, axis=0)[-10], 10)
    lexical.search(held, every, np.zeros(len(every), bool), block, measure, leaders)
    assert sum(scored) < 0.1 * bounds.size
    assert [sorted(leaders.rows[1][leaders.rows[0] == k]) for k in range(len(block.items))] == [sorted(c[c >= max(1, np.sort(c)[-10])])[-10:] for c in scores.T]
