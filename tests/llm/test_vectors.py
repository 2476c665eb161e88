from collections import defaultdict

import numpy as np
import pytest

from tideline.llm.covertree import cover_tree, top_products
from tideline.llm.durable import let_workers_import
from tideline.llm.graph import nearest

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def table(spark):
    let_workers_import(spark)
    return lambda rows: spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, v int, score int")


def odd_rows(rng):
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(240)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # copies
    rows += [(400, None), (401, [0.1, None]), (402, [NAN] * 8), (403, [INF, 0.0]), (None, [0.1] * 8), (404, [0.0] * 8)]
    return rows + [(405, [0.3]), (7, [0.2] * 8), (20, [0.4] * 8)]  # short, and ids used twice


def valid(rows, zero):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and (zero or v.any())]
    return [i for i, _ in ok], np.stack([np.pad(v, (0, 8 - len(v))) for _, v in ok])


def grouped(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def test_products_against_brute_force(table):
    rows = odd_rows(np.random.default_rng(1))
    ids, v = valid(rows, zero=True)
    v = np.floor(64 * v).astype(int)
    found = grouped(top_products(table(rows), every=20, best=20))
    assert set(found) == {i for i in ids if i % 20 == 0}
    for q, got in found.items():
        if q == 20:
            continue  # two vectors ask under one id
        s = v @ v[ids.index(q)]
        best = sorted((-x, i) for x, i in zip(s.tolist(), ids) if i != q)[:20]
        assert got == [(k + 1, i, -x) for k, (x, i) in enumerate(best)]


def test_products_over_several_shards(table, monkeypatch):
    import tideline.llm.covertree as covertree

    monkeypatch.setattr(covertree, "SHARD_ROWS", 64)
    test_products_against_brute_force(table)


def test_few_rows_and_none(table):
    assert grouped(top_products(table([(0, [1.0, 0.0]), (3, [0.5, 9.0])]))) == {0: [(1, 3, 2048)]}
    assert grouped(nearest(table([(0, [1.0, 0.0]), (3, [0.5, 0.0])]))) == {0: [(1, 3, 1.0)]}
    for search in (top_products, nearest):
        assert search(table([])).collect() == []
        assert search(table([(0, [1.0])])).collect() == []


@pytest.mark.parametrize("width", [2, 3, 16, 64])
def test_cover_trees_cover_and_separate(width):
    from tideline.llm.covertree import BASE, LEAF

    points = np.random.default_rng(2).normal(size=(900, width))
    points[700:760] = points[5]  # copies
    apart = lambda x, y: np.sqrt(((x - y) ** 2).sum(-1))

    def walk(node):
        assert apart(points[node.rows], node.center).max() <= node.radius + 1e-6 <= BASE**node.level + 1e-5 or node.radius == 0
        if not node.children:
            assert len(node.rows) <= LEAF or node.radius < 1e-6
            return 1
        assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        centers = np.stack([c.center for c in node.children])
        between = apart(centers[:, None], centers[None, :]) + 1e9 * np.eye(len(centers))
        reach = BASE ** (node.level - 1)
        assert between.min() > reach - 1e-6 and all(c.radius <= reach + 1e-6 and c.level < node.level for c in node.children)
        return 1 + sum(map(walk, node.children))

    assert walk(cover_tree(points, np.arange(900))) > 5


def _searched(points, queries, best=5):
    from tideline.llm.covertree import DualSearch

    found = DualSearch(points, np.arange(len(points)), queries, -1 - np.arange(len(queries)), np.full(len(queries), -np.inf), best)
    found.run()
    scores = queries @ points.T
    want = np.lexsort((np.broadcast_to(np.arange(len(points)), scores.shape), -scores), axis=1)[:, :best]
    assert (found.found == want).all()
    return found


def test_groups_of_queries_prune_groups_of_data():
    """Where vectors lie in few dimensions, most pairs are never compared; where not, the result is still exact."""
    rng = np.random.default_rng(9)
    plane = rng.normal(size=(6_000, 3)) @ rng.normal(size=(3, 40)) * 10
    near = _searched(np.floor(plane[:5_000]), np.floor(plane[5_000:]))
    assert near.pruned > 0.1 * near.met and near.compared < 0.2 * 5_000 * 1_000
    wide = np.floor(64 * rng.normal(size=(1_200, 64)))
    _searched(wide[:1_000], wide[1_000:])


def test_neighbours_with_copies(table):
    rows = odd_rows(np.random.default_rng(3))
    ids, v = valid(rows, zero=False)
    u = v / np.sqrt((v**2).sum(1))[:, None]
    hits = total = 0
    for q, got in grouped(nearest(table(rows), every=50, best=5, shard_rows=100)).items():
        s = u @ u[ids.index(q)]
        best = sorted((-x, i) for x, i in zip(s.round(12).tolist(), ids) if i != q)[:5]
        hits, total = hits + len({i for _, i in best} & {i for _, i, _ in got}), total + 5
        for _, i, score in got:
            assert any(abs(score - s[k]) < 1e-12 for k, other in enumerate(ids) if other == i)
        assert [k for k, _, _ in got] == [1, 2, 3, 4, 5]
    assert hits >= 0.95 * total


def test_recall_on_real_vectors(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    ids, u = [i for i, _ in rows], np.array([v for _, v in rows], float)
    u /= np.sqrt((u**2).sum(1))[:, None]
    found = grouped(nearest(frame))
    hits = 0
    for q, got in found.items():
        best = sorted((-x, i) for x, i in zip((u @ u[ids.index(q)]).tolist(), ids) if i != q)[:5]
        hits += len({i for _, i in best} & {i for _, i, _ in got})
    assert hits >= 0.95 * 5 * len(found)


def test_given_vectors_are_pruned(spark, sf_dir):
    from tideline.llm.covertree import DualSearch

    v = [r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    v = np.floor(64 * np.array(v, float))
    asked = v[::20]
    floors = np.sort(asked @ v.T, axis=1)[:, -2].copy()  # of few rows, the second best is what the 20th is of many
    found = DualSearch(v, np.arange(len(v)), asked, -1 - np.arange(len(asked)), floors, 2)
    found.run()
    assert found.compared < 0.9 * len(v) * len(asked) and found.pruned > 0.3 * found.met  # far more of more rows
