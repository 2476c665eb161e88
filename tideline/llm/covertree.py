"""Exact highest inner products by a dual-tree search over cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.durable import written
from tideline.llm.sampling import sampled
from tideline.llm.vectors import matrix, search_shards, usable

MOST_SAMPLED = 4_096  # bound of the sample that gives pivots and first thresholds
SHARD_ROWS = 8_192
LEAF = 8  # points that are not split further
SAME = 1e-7  # relative distances that rounding makes of copies; whole numbers have none
LOWEST = -1_000  # the level of copies
GROUP = 4  # queries that are not split further
BASE = 1.3  # radii of neighbouring levels
NET_BLOCK = 512
POINTS = 512  # compared between two looks at the floors
SCALE = 64.0


@dataclass
class Node:
    """Points ``rows``, all within ``radius`` of ``center``, which is at most BASE ** ``level``.

    Centers of its children are more than BASE ** (level - 1) apart, and each child is within that
    of its own center. Nodes of at most ``leaf`` points, or of copies of one, are leaves.
    """

    rows: np.ndarray
    center: np.ndarray
    radius: float
    level: int
    children: list[Node]


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(1)[:, None] + (others**2).sum(1)[None, :] - 2 * (points @ others.T)
    return np.sqrt(np.maximum(squares, 0))


def _net(points: np.ndarray, reach: float) -> np.ndarray:
    """Indexes of points that are more than ``reach`` apart, so many that every point is within it of one."""
    chosen: list[int] = [0]
    for a in range(0, len(points), NET_BLOCK):
        block = points[a : a + NET_BLOCK]
        far = np.flatnonzero(_distances(block, points[chosen]).min(1) > reach)
        among = _distances(block[far], block[far])
        new: list[int] = []
        for i in range(len(far)):
            if not new or among[i, new].min() > reach:
                new.append(i)
        chosen += (a + far[new]).tolist()
    return np.array(chosen)


def cover_tree(points: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """The cover tree of ``points[rows]``, from the highest level down; levels that would have one node are skipped."""
    center = points[rows[0]]
    distance = _distances(points[rows], center[None, :])[:, 0]
    radius = float(distance.max())
    node = Node(rows, center, radius, LOWEST, [])
    if radius <= SAME * (1 + np.sqrt(center @ center)):
        return node
    node.level = int(np.ceil(np.log(radius) / np.log(BASE) - 1e-12))
    if len(rows) <= leaf:
        return node
    reach = BASE ** (node.level - 1)
    net = _net(points[rows], reach)
    owner = np.empty(len(rows), np.int64)
    for a in range(0, len(rows), NET_BLOCK):
        owner[a : a + NET_BLOCK] = _distances(points[rows[a : a + NET_BLOCK]], points[rows[net]]).argmin(1)
    owner[net] = np.arange(len(net))
    order = np.argsort(owner, kind="stable")
    for first, members in zip(net, np.split(order, np.searchsorted(owner[order], np.arange(1, len(net))))):
        members = np.concatenate([[first], members[members != first]])
        node.children.append(cover_tree(points, rows[members], leaf))
    return node


class Flat:
    """A tree as arrays: node k has the children ``first[k]`` to ``first[k] + many[k]``, and
    its points are ``rows[start[k]:end[k]]``."""

    def __init__(self, root: Node):
        nodes, at = [root], 0
        first, many = [], []
        while at < len(nodes):
            first.append(len(nodes))
            many.append(len(nodes[at].children))
            nodes += nodes[at].children
            at += 1
        self.first, self.many = np.array(first), np.array(many)
        self.centers = np.stack([n.center for n in nodes])
        self.radii = np.array([n.radius for n in nodes])
        self.norms = np.sqrt((self.centers**2).sum(1))
        self.rows = [n.rows for n in nodes]


class DualSearch:
    """The ``best`` highest inner products of each query, with ties to the smaller id.

    Queries and data are indexed together: a group of queries, a node of their tree, meets a
    frontier of data nodes. Those whose covering radii prove that no product reaches the
    group's worst ``best``-th score are pruned for the whole group; then the frontier's large nodes are
    opened or the group is split, whichever is wider. ``met`` and ``pruned`` count pairs of nodes,
    ``compared`` pairs of points.
    """

    def __init__(self, points, ids, queries, query_ids, floors, best: int):
        self.points, self.ids, self.queries, self.query_ids, self.best = points, ids, queries, query_ids, best
        self.floors = floors  # a score that at least ``best`` candidates reach
        self.scores = np.full((len(queries), best), -np.inf)
        self.found = np.full((len(queries), best), -1, np.int64)
        self.met = self.pruned = self.compared = 0

    def run(self) -> None:
        if not len(self.points) or not len(self.queries):
            return
        self.data = Flat(cover_tree(self.points, np.arange(len(self.points))))
        asked = cover_tree(self.queries, np.arange(len(self.queries)), GROUP)
        self._visit(asked, np.zeros(1, np.int64))

    def bounds(self, q: Node, nodes: np.ndarray) -> np.ndarray:
        """No query below q has a higher product with a point below the node."""
        data, norm = self.data, float(np.sqrt(q.center @ q.center))
        radii = data.radii[nodes]
        return data.centers[nodes] @ q.center + norm * radii + q.radius * (data.norms[nodes] + radii)

    def _visit(self, q: Node, nodes: np.ndarray) -> None:
        while True:
            bound = self.bounds(q, nodes)
            # rounding of the bound must not prune an equal score
            good = bound * (1 + 1e-12) + 1e-6 >= self.floors[q.rows].min()
            self.met += len(nodes)
            self.pruned += int((~good).sum())
            nodes, bound = nodes[good], bound[good]
            if not len(nodes):
                return
            inner = self.data.many[nodes] > 0
            if q.children and (not inner.any() or q.radius > self.data.radii[nodes[inner]].max()):
                for child in q.children:
                    self._visit(child, nodes)
                return
            if not inner.any():
                order = np.argsort(-bound, kind="stable")
                self._compare(q.rows, nodes[order], bound[order])
                return
            first, many = self.data.first[nodes[inner]], self.data.many[nodes[inner]]
            opened = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            nodes = np.concatenate([nodes[~inner], opened])

    def _compare(self, q: np.ndarray, nodes: np.ndarray, bound: np.ndarray) -> None:
        """Leaves of descending bounds, until the next one's bound is below the group's worst floor."""
        ends = np.cumsum([len(self.data.rows[k]) for k in nodes])
        at = 0
        while at < len(nodes):
            if bound[at] * (1 + 1e-12) + 1e-6 < self.floors[q].min():
                self.pruned += len(nodes) - at
                return
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POINTS, "right")))
            part = np.concatenate([self.data.rows[k] for k in nodes[at:upto]])
            at = upto
            self.compared += len(q) * len(part)
            scores = self.queries[q] @ self.points[part].T
            good = (scores >= self.floors[q][:, None]) & (self.query_ids[q][:, None] != self.ids[part][None, :])
            i, j = np.nonzero(good)
            if not len(i):
                continue
            old = np.repeat(np.arange(len(q)), self.best)
            who = np.concatenate([old, i])
            score = np.concatenate([self.scores[q].ravel(), scores[i, j]])
            ids = np.concatenate([self.found[q].ravel(), self.ids[part[j]]])
            order = np.lexsort((ids, -score, who))
            who = who[order]
            first = np.searchsorted(who, np.arange(len(q)))
            keep = order[(first[:, None] + np.arange(self.best)).ravel()]
            self.scores[q], self.found[q] = score[keep].reshape(len(q), -1), ids[keep].reshape(len(q), -1)
            self.floors[q] = np.maximum(self.floors[q], self.scores[q, -1])


def top_products(
    embeddings: DataFrame,
    every: int = 20,
    best: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: per query (ids divisible by ``every``) the ``best`` highest
    inner products over all other rows; a component x counts as floor(64 * x).

    Vectors that are null or hold a null or non-finite component, and rows without an id, take
    no part; shorter vectors are as if they ended in zeros. A query never finds rows of its own
    id; repeated rows are found each. Fewer rows than ``best``: all. No rows: no rows.
    Sums are exact while they stay below 2 ** 53.

    The top of the data tree is in Spark: pivots from a bounded sample split the rows into
    shards, each with its covering radius. The sample also gives every query a score that
    ``best`` rows reach; a query goes to no shard whose bound lies below it. Inside a shard
    both sides are cover trees, searched together. A pivot that many rows share is
    split by a hash of the id, so no shard grows with the data.
    """
    floor = F.transform("v", lambda x: F.floor(F.lit(SCALE) * x).cast("double"))
    # rows that a query's own id could answer are told apart only by id
    rows = written(usable(embeddings, vec_id, embedding).select("vec_id", floor.alias("v")), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = size["n"], max(size["width"] or 0, 1)
    sample = sampled(rows, "vec_id", MOST_SAMPLED, n, 3).toArrow()
    sample_ids, sample_rows = sample["vec_id"].to_numpy(), matrix(sample["v"], width)
    pivots = sample_rows[_spread(sample_rows, max(1, min(-(-n // SHARD_ROWS), MOST_SAMPLED // 4)))]
    shared = rows.sparkSession.sparkContext.broadcast((pivots, sample_ids, sample_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value[0]
        for batch in batches:
            v = matrix(batch.column(1), width)
            d = (pivots**2).sum(1)[None, :] - 2 * (v @ pivots.T) + (v**2).sum(1)[:, None]
            near = d.argmin(1)
            far = np.sqrt(((v - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(far)],
                ["vec_id", "v", "pivot", "far"],
            )

    placed = written(rows.mapInArrow(place, "vec_id long, v array<double>, pivot int, far double"), "placed")
    balls = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    radii, parts = np.full(len(pivots), -1.0), np.ones(len(pivots), np.int64)
    for ball in balls:
        radii[ball["pivot"]], parts[ball["pivot"]] = ball["radius"], -(-ball["n"] // SHARD_ROWS)
    split = F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("pivot") + 1)
    data = placed.select("vec_id", "v", "pivot", F.pmod(F.xxhash64(F.lit(9), "vec_id"), split).cast("int").alias("part"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, ids, known = shared.value
        for batch in batches:
            q, own = matrix(batch.column(1), width), batch.column(0).to_numpy()
            scores = q @ known.T
            scores[own[:, None] == ids[None, :]] = -np.inf
            floors = np.full(len(q), -np.inf)
            if scores.shape[1] >= best:
                floors = np.partition(scores, -best, axis=1)[:, -best]
            norms = np.sqrt((q**2).sum(1))
            reach = q @ pivots.T + norms[:, None] * np.maximum(radii, 0)[None, :]
            wanted = (reach * (1 + 1e-12) + 1e-6 >= floors[:, None]) & (radii >= 0)[None, :]
            i, pivot = np.nonzero(wanted)
            copies = parts[pivot]
            i, pivot = np.repeat(i, copies), np.repeat(pivot, copies)
            part = np.arange(len(i)) - np.repeat(np.cumsum(copies) - copies, copies)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(pivot.astype(np.int32)),
                 pa.array(part.astype(np.int32)), pa.array(floors[i])],
                ["vec_id", "v", "pivot", "part", "floor"],
            )

    asked = rows.filter(F.col("vec_id") % every == 0)
    n_queries = asked.count()
    queries = asked.mapInArrow(route, "vec_id long, v array<double>, pivot int, part int, floor double")

    def search(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, query_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        found = DualSearch(
            matrix(left["v"], width), ids, matrix(right["v"], width), query_ids, right["floor"].to_numpy().copy(), best
        )
        found.run()
        i, k = np.nonzero(np.isfinite(found.scores))
        return pa.table({"query_id": query_ids[i], "vec_id": found.found[i, k], "score": found.scores[i, k]})

    result = search_shards(data, queries, n_queries, ["pivot", "part"], search, best)
    return result.withColumn("score", F.col("score").cast("long"))


def _spread(points: np.ndarray, count: int) -> np.ndarray:
    """Indexes of ``count`` points, each the farthest from those before it."""
    chosen = [0] if len(points) else []
    distance = ((points - points[0]) ** 2).sum(1) if len(points) else np.zeros(0)
    while len(chosen) < min(count, len(points)) and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen, int)
