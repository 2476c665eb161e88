import numpy as np

from tideline.llm.components import connected
from tideline.llm.minhash import near_duplicates


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(rows, percent=75):
    """component of every row by comparing all pairs"""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def text_of(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 5_000, n))


def edited(rng, text, edits):
    words = text.split()
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"e{rng.integers(0, 10**9)}"
    return " ".join(words)


def test_against_all_pairs(docs):
    rng = np.random.default_rng(8)
    texts = [text_of(rng, n) for n in (3, 4, 5, 6, 9, 40, 200, 400)]
    rows, base = [], text_of(rng, 150)
    for t in texts:
        rows += [t, t.upper(), t.replace(" ", "\n\t"), t + " more", edited(rng, t, 1)]
    rows += [edited(rng, base, k) for k in rng.integers(0, 12, 60)]  # many around the limit, few alike
    passage = text_of(rng, 60)
    rows += [passage + " " + text_of(rng, 80) for _ in range(25)]  # one passage, no copies
    rows += ["a b c d e f g h", "a b c d e f g", " ", "x", "x", "X y", ""]
    numbered = [(int(d), t) for d, t in zip(rng.permutation(len(rows)), rows)]
    assert sorted(tuple(r) for r in near_duplicates(docs(numbered)).collect()) == components(numbered)


def test_many_texts_around_the_limit(docs, spark, monkeypatch):
    """500 texts of one base, each pair at 0.70 to 0.76: no link is lost and no pair compared twice."""
    from tideline.llm import minhash

    compared = []
    plain = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda p, *rest: compared.append(p) or plain(p, *rest))
    rng = np.random.default_rng(31)
    base = text_of(rng, 1500)
    rows = [(int(d), edited(rng, base, int(rng.integers(22, 28)))) for d in rng.permutation(500)]
    found = sorted(tuple(r) for r in near_duplicates(docs(rows)).collect())
    assert found == components(rows) and 1 < len({r[2] for r in found}) < 500
    pairs = [tuple(r) for p in compared for r in p.collect()]
    assert len(pairs) == len(set(pairs)) < 500 * 499 / 6


def test_bitmaps_rule_out_no_similar_pair(docs, spark):
    from pyspark.sql import functions as F

    from tideline.llm.minhash import _may_be_similar, bitmap

    rng = np.random.default_rng(6)
    rows, truth = [], []
    for n in (1, 3, 40, 63, 64, 65, 130, 700, 30_000):
        for share in (0.3, 0.7, 0.74, 0.75, 0.76, 1.0):
            both = max(1, int(n * share))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[:both], rng.integers(0, 1 << 63, int(rng.integers(0, n - both + 1)), dtype=np.uint64)]))
            rows.append((len(a), bitmap(a).tolist(), len(b), bitmap(b).tolist()))
            common = len(np.intersect1d(a, b))
            truth.append(100 * common >= 75 * (len(a) + len(b) - common))
    frame = spark.createDataFrame(rows, "a_n long, a_bits array<long>, b_n long, b_bits array<long>")
    told = [r[0] for r in frame.select(_may_be_similar("a", "b", 75)).collect()]
    assert all(t for t, real in zip(told, truth) if real)
    assert sum(t != real for t, real in zip(told, truth)) < len(truth) / 4


def test_a_text_that_most_documents_hold(docs):
    rows = [(i, "a b c d e f g") for i in range(10, 400)] + [(i, f"p{i} q r s t u") for i in range(400, 500)] + [(3, "a b c d e f g")]
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(docs(rows)).collect()}
    assert found == {i: (3, i == 3) for i, t in rows if t[0] == "a"} | {i: (i, True) for i in range(400, 500)}


def test_odd_rows(docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, ""), (9, "q " * 40_000)]
    found = sorted(near_duplicates(docs(rows)).collect(), key=repr)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append((r["component_id"], r["kept"]))
    assert by_id == {5: [(2, False)] * 2, 2: [(2, True)], None: [(None, True)], 7: [(7, True)], 8: [(8, True)], 9: [(9, True)]}


def test_rows_that_share_an_id(docs):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (3, "p q r s t u"), (4, "a b c d e f")]
    found = {(r["doc_id"], r["component_id"]) for r in near_duplicates(docs(rows)).collect()}
    assert found == {(1, 1), (3, 1), (4, 1)}


def test_no_rows(docs):
    assert near_duplicates(docs([])).collect() == []


def test_chains_and_stars_are_connected(spark):
    chain = [(i, i + 1) for i in range(200, 300)]
    star = [(1000, k) for k in range(1001, 1400)]
    links = chain + [(b, a) for a, b in star] + [(7, 7), (5, 6), (6, 5), (5, 6)]
    roots = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({roots[i] for i in range(200, 301)}) == 1
    assert len({roots[i] for i in range(1000, 1400)}) == 1
    assert len(set(roots.values())) == 3 and 7 not in roots
