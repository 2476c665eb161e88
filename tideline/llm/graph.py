"""Approximate nearest neighbours over robust-pruned directed graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.durable import written
from tideline.llm.vectors import matrix, search_shards, usable

SHARD_ROWS = 8_192
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
RELAXED = 1.2
BATCH = 256


class Graph:
    """A graph over the distinct rows of ``points`` (unit vectors): few edges each, long and short.

    Points join in batches. A greedy search from the entry point, over the graph so far,
    proposes neighbours; pruning keeps the nearest and then only those that no kept one
    is RELAXED times nearer to. Every edge is offered to its other end, which prunes again
    when full.
    """

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None):
        self.points = points.astype(np.float32)
        n = len(points)
        mean = self.points.mean(0) if n else None
        self.entry = int((self.points @ mean).argmax()) if n else 0
        if edges is not None:
            self.edges = edges
            return
        self.edges = np.full((n, DEGREE), -1, np.int32)
        order = np.random.default_rng(11).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]]) if n else order
        done = 1
        while done < n:
            size = min(BATCH, max(done, 8), n - done)
            self._add(order[done : done + size])
            done += size

    def _near(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances (1 - cosine) of each query to its own rows; none is infinitely far."""
        d = 1 - np.einsum("bd,bkd->bk", queries, self.points[rows])
        d[rows < 0] = np.inf
        return d

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of each query's beam, nearest first: expand the nearest row that was
        not, until all in the beam were."""
        b = len(queries)
        rows = np.full((b, beam), -1, np.int64)
        rows[:, 0] = self.entry
        far = self._near(queries, rows)
        seen = np.zeros((b, beam), bool)
        while True:
            open_ = np.where(seen | (rows < 0), np.inf, far)
            pick = open_.argmin(1)
            active = np.flatnonzero(np.isfinite(open_[np.arange(b), pick]))
            if not len(active):
                return rows, far
            seen[active, pick[active]] = True
            new = self.edges[rows[active, pick[active]]].astype(np.int64)
            new[(new[:, :, None] == rows[active][:, None, :]).any(2)] = -1
            d = self._near(queries[active], new)
            all_rows = np.concatenate([rows[active], new], 1)
            all_far = np.concatenate([far[active], d], 1)
            all_seen = np.concatenate([seen[active], np.zeros_like(new, bool)], 1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            rows[active] = np.take_along_axis(all_rows, order, 1)
            far[active] = np.take_along_axis(all_far, order, 1)
            seen[active] = np.take_along_axis(all_seen, order, 1)

    def _prune(self, own: np.ndarray, rows: np.ndarray, far: np.ndarray) -> np.ndarray:
        """At most DEGREE neighbours of each point from its candidates."""
        order = np.argsort(far, axis=1, kind="stable")
        rows, far = np.take_along_axis(rows, order, 1), np.take_along_axis(far, order, 1)
        gone = (rows < 0) | (rows == own[:, None])
        between = 1 - np.einsum("bkd,bjd->bkj", self.points[rows], self.points[rows])
        kept = np.full((len(own), DEGREE), -1, np.int32)
        count, line = np.zeros(len(own), int), np.arange(len(own))
        for _ in range(DEGREE):
            pick = (~gone).argmax(1)
            live = np.flatnonzero(~gone[line, pick])
            if not len(live):
                break
            p = pick[live]
            kept[live, count[live]] = rows[live, p]
            count[live] += 1
            gone[live] |= RELAXED * between[live, p] <= far[live]
            gone[live, p] = True
        return kept

    def _add(self, new: np.ndarray) -> None:
        rows, far = self.search(self.points[new], BUILD_BEAM)
        self.edges[new] = self._prune(new, rows, far)
        a = np.repeat(new, DEGREE)
        b = self.edges[new].ravel()
        a, b = a[b >= 0], b[b >= 0].astype(np.int64)
        order = np.argsort(b, kind="stable")
        ends, first, many = np.unique(b[order], return_index=True, return_counts=True)
        for at in range(0, len(ends), BATCH):
            e, m, f = ends[at : at + BATCH], many[at : at + BATCH], first[at : at + BATCH]
            offered = np.full((len(e), int(m.max())), -1, np.int64)
            line = np.repeat(np.arange(len(e)), m)
            column = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            offered[line, column] = a[order][np.repeat(f, m) + column]
            both = np.concatenate([self.edges[e].astype(np.int64), offered], 1)
            fits = (both >= 0).sum(1) <= DEGREE
            if fits.any():
                packed = np.take_along_axis(both[fits], np.argsort(both[fits] < 0, axis=1, kind="stable"), 1)
                self.edges[e[fits]] = packed[:, :DEGREE]
            if (~fits).any():
                full = e[~fits]
                self.edges[full] = self._prune(full, both[~fits], self._near(self.points[full], both[~fits]))


def nearest(
    embeddings: DataFrame,
    every: int = 50,
    best: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: per query (ids divisible by ``every``) the ``best`` largest
    cosines that beam searches over all shards find, ties to the smaller id.

    Every row is in one shard's graph, which is built once and stored; a query searches each shard, and scores
    are computed in double precision from the original vectors. Rows with equal directions are one point of
    the graph, and all of them are looked at where it is found: copies neither crowd out its edges
    nor get lost.

    Vectors that are null, zero, or hold a null or non-finite component, and rows without an
    id, take no part; shorter vectors are as if they ended in zeros. A query never finds
    rows of its own id; repeated rows are found each. Fewer rows than ``best``: all.
    """
    zero = F.forall("v", lambda x: x == 0)
    rows = written(usable(embeddings, vec_id, embedding).filter(~zero), "vectors")
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")
    ).first()
    width, shards = max(size["width"] or 0, 1), max(1, -(-size["n"] // shard_rows))
    data = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def build(part: pa.Table) -> pa.Table:
        """The shard's rows by point and id; the first of a point carries its edges."""
        part = part.sort_by("vec_id")
        unit = _directions(matrix(part["v"], width))
        _, first, back = np.unique(unit, axis=0, return_index=True, return_inverse=True)
        back = back.ravel()
        edges = Graph(unit[first]).edges
        order = np.argsort(back, kind="stable")
        opens = np.diff(back[order], prepend=-1) > 0
        own = [edges[p][edges[p] >= 0].tolist() if new else None for p, new in zip(back[order], opens)]
        part = part.take(pa.array(order))
        return part.append_column("point", pa.array(back[order], pa.int32())).append_column("edges", pa.array(own, pa.list_(pa.int32())))

    # Graphs are built once and kept beside their rows, however many blocks of queries come.
    kinds = "vec_id long, v array<double>, shard int, point int, edges array<int>"
    data = written(data.select("vec_id", "v", "shard").groupBy("shard").applyInArrow(build, kinds), "graphs")

    def search(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            left = left.sort_by([("point", "ascending"), ("vec_id", "ascending")])
            own, asked = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            v, q = matrix(left["v"], width), matrix(right["v"], width)
            v_size, q_size = np.sqrt((v**2).sum(1)), np.sqrt((q**2).sum(1))
            many = np.bincount(left["point"].to_numpy())
            start = np.cumsum(many) - many
            lists = left["edges"].combine_chunks().drop_null()
            sizes = np.diff(lists.offsets.to_numpy())
            edges = np.full((len(many), DEGREE), -1, np.int32)
            edges[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
            graph = Graph(_directions(v[start]), edges)
            q_unit = _directions(q)
            for at in range(0, len(q), BATCH):
                hits, _ = graph.search(q_unit[at : at + BATCH], SEARCH_BEAM)
                for i, line in enumerate(hits, at):
                    line = line[line >= 0]
                    rows = np.repeat(start[line] - (np.cumsum(many[line]) - many[line]), many[line]) + np.arange(many[line].sum())
                    rows = rows[own[rows] != asked[i]]
                    score = (v[rows] / v_size[rows][:, None]) @ (q[i] / q_size[i])
                    exact = np.einsum("kd,d->k", v[rows], q[i]) / (v_size[rows] * q_size[i])
                    score = np.where(np.isfinite(exact), exact, score)
                    top = np.lexsort((own[rows], -score))[:best]
                    found.append((np.full(len(top), asked[i]), own[rows[top]], score[top]))
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), parts)))

    return search_shards(data, queries, size["q"] or 0, ["shard"], search, best)


def _directions(v: np.ndarray) -> np.ndarray:
    """Vectors of length one, in 32 bits; scaled first, so that no square overflows or vanishes."""
    unit = v / np.abs(v).max(1)[:, None]
    return (unit / np.sqrt((unit**2).sum(1))[:, None]).astype(np.float32)
