import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm.resampling import appended, features, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(rows, target, percent=25, min_words=20, seed=7):
    buckets = 10_000
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for texts, held in ((rows, s), (target, t)):
        for _, text in texts:
            for f in runs_of(text)[1]:
                held[crc32(f.encode()) % buckets] += 1
    top = lambda b: (t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets))
    out, pool = {}, []
    for place, (i, text) in enumerate(rows):
        words, found = runs_of(text)
        gains = [math.floor(1000 * math.log(top(crc32(f.encode()) % buckets))) for f in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[place] = [i, len(found), weight, score, None]
        if len(words) >= min_words:
            pool.append((-score, i is None, i or 0, place))
    for rank, (*_, place) in enumerate(sorted(pool)[: percent * len(pool) // 100], 1):
        out[place][4] = rank
    return sorted((tuple(r) for r in out.values()), key=repr)


def rows_like(rng, n):
    words = [f"w{k}" for k in range(300)] + ["É1", "ünï", "Zz9", "x" * 500]
    return [(int(i), " ".join(rng.choice(words, rng.integers(0, 90)))) for i in rng.permutation(n)]


def test_against_brute_force(docs, rows_of):
    rng = np.random.default_rng(3)
    rows, target = rows_like(rng, 300), rows_like(rng, 12)
    rows += [(900, None), (901, ""), (902, "?! --"), (903, "A-b\x00c_d" * 30), (904, "w1 " * 50_000)]
    assert sorted(rows_of(resample(docs(rows), docs(target))), key=repr) == brute(rows, target)


def test_ties_repeats_and_null_ids(docs, rows_of):
    text = "one two three four five six seven eight nine ten " * 2
    rows = [(5, text)] * 9 + [(None, text)] * 3 + [(6, text), (7, text)]
    found = rows_of(resample(docs(rows), docs([(1, "one two")]), percent=50))
    assert sorted(found, key=repr) == brute(rows, [(1, "one two")], percent=50)
    assert sorted(r[4] for r in found if r[4]) == [1, 2, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short")]])
def test_little_or_nothing(docs, rows_of, rows):
    for target in ([], [(1, "w")]):
        assert sorted(rows_of(resample(docs(rows), docs(target)))) == brute(rows, target)


def test_checksums_of_joined_strings():
    parts = [(b"", b"x"), (b"ab ", b"c"), (b"q" * 70, b"r" * 1000), (b"\xc3\xa9 ", b"")]
    left, right = (np.array([crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    sizes = np.array([len(p[1]) for p in parts])
    assert appended(left, right, sizes).tolist() == [crc32(a + b) for a, b in parts]


def test_pairs_stay_inside_their_text():
    found = features(pa.array(["a b", "", "c", "d e f"], pa.large_string()))
    assert found.counts.tolist() == [2, 0, 1, 3] and found.first.tolist() == [0, 3, 4]
    assert found.pairs.tolist() == [crc32(p) % 10_000 for p in (b"a b", b"d e", b"e f")]
