import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideline.llm.packing import best_fit, configuration, configuration_program, knapsack, pack, plan, rounded

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, found, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [
            (k, k * capacity, min(capacity, len(ids) - k * capacity)) for k in range(-(-len(ids) // capacity))
        ]
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_round_trip_of_odd_texts(docs):
    rows = [
        (1, None), (2, ""), (3, "Hello WORLD, don't 12 stop"), (4, "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|>"),
        (5, "naïve Ⅷ ½ İstanbul ΣΑΣ 中文 emoji 😀 é x \x1c y"), (6, "word " * 5_000), (7, "z" * 3_000), (8, " \t\n"),
    ]
    assert check(rows, pack(docs(rows), PATH, 64).collect(), 64) >= 1
    assert pack(docs([]), PATH, 64).collect() == []


def test_rows_without_or_with_repeated_ids(docs):
    found = pack(docs([(None, "a b"), (1, "c"), (1, "c")]), PATH, 16).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in found) == [(False, 2), (False, 2), (True, 3)]


def test_real_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    found = pack(frame, PATH).collect()
    used = check(rows, found, 2048)
    assert used <= -(-sum(r["length"] for r in found) // 2048) * 1.01 + 1


@given(st.lists(st.integers(1, 50), max_size=300))
@settings(max_examples=40, deadline=None)
def test_plans_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=51)
    made = plan(counts, 50)
    assert (sum((u * c for u, c in made), np.zeros(51, int)) == counts).all()
    assert all((u * np.arange(51)).sum() <= 50 for u, _ in made)
    assert sum(c for _, c in made) <= 11 / 9 * max(1, -(-sum(lengths) // 50)) * 1.5 + 1


def test_large_histograms_come_close_to_the_bound():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.clip(rng.lognormal(5.5, 0.9, 200_000).astype(int), 1, 900), minlength=2049)
    made = plan(counts, 2048)
    bound = -(-int(counts @ np.arange(2049)) // 2048)
    assert sum(c for _, c in made) <= bound * 1.002


def test_pricing_is_a_knapsack_over_all_lengths():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths, prices = np.flatnonzero(np.arange(13) * rng.integers(0, 2, 13)), rng.random(13)
        value, first = knapsack(prices, lengths, 12)
        most = [12 // k for k in lengths]
        best = np.zeros(13)
        for pick in np.ndindex(*(m + 1 for m in most)):
            size = sum(p * k for p, k in zip(pick, lengths))
            if size <= 12:
                worth = sum(p * prices[k] for p, k in zip(pick, lengths))
                best[size:] = np.maximum(best[size:], worth)
        assert value == pytest.approx(best)
        for seed in lengths.tolist():
            used = configuration(seed, first, 12)
            assert sum(k * n for k, n in used.items()) <= 12
            assert sum(prices[k] * n for k, n in used.items()) == pytest.approx(prices[seed] + best[12 - seed])


def test_the_program_comes_close_to_its_dual_bound():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(rng.lognormal(4.0, 0.7, 20_000).astype(int), 1, 200), minlength=257)
    found = configuration_program(counts, 256, bounded=True)
    held = np.zeros(257)
    for used, times in found.columns:
        assert sum(k * n for k, n in used.items()) == 256
        for k, n in used.items():
            held[k] += times * n
    assert held + found.rest == pytest.approx(counts.astype(float))
    assert found.bound >= counts @ np.arange(257) / 256
    assert found.sequences <= found.bound <= found.sequences + best_tail(found.rest, 256) + 1e-6
    assert found.sequences >= 0.99 * found.bound


def best_tail(rest, capacity):
    return sum(c for _, c in best_fit(np.ceil(rest - 1e-9).astype(int), capacity))


def test_most_pieces_go_by_configurations_of_the_program():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.clip(rng.lognormal(4.0, 0.7, 30_000).astype(int), 1, 200), minlength=257)
    made, rest = rounded(counts, 256)
    assert rest.sum() <= 0.1 * counts.sum()
    assert all((u * np.arange(257)).sum() == 256 for u, _ in made)


def test_the_program_beats_best_fit_where_lengths_must_match():
    counts = np.zeros(101, int)
    counts[[51, 27, 26, 23]] = 600, 600, 600, 1200
    assert sum(c for _, c in plan(counts, 100)) == 900 < sum(c for _, c in best_fit(counts, 100)) == 1100
