"""Packing token sequences: a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.durable import written

RATE = 8.0  # how fast the price of a covered length falls
IDLE = 8
SHARE = 0.2  # of the scarcest length that one use of a configuration may cover
RUN_BYTES = 2 << 20  # of text that a worker encodes at a time


@dataclass(frozen=True)
class Layout:
    """Where every rank of every length goes; ``keys`` is length << 40 | first rank, ascending."""

    keys: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    count: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.keys, (length << 40) | rank, "right") - 1
        return self.sequences[k] + rank - (self.keys[k] & ((1 << 40) - 1)), self.offsets[k]


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every size up to ``capacity`` the highest price of lengths that fit into it, and the length
    to put in first, 0 where a token stays empty. Dynamic programming over all ``lengths``, ascending."""
    value, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    priced = prices[lengths]
    for size in range(1, capacity + 1):
        n = np.searchsorted(lengths, size, "right")
        value[size] = value[size - 1]
        if n:
            worth = value[size - lengths[:n]] + priced[:n]
            best = n - 1 - int(worth[::-1].argmax())  # of equals the longest: short ones fit later
            if worth[best] > value[size]:
                value[size], first[size] = worth[best], lengths[best]
    return value, first


def configuration(seed: int, first: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest configuration that holds ``seed``: length -> how often."""
    used, room = {seed: 1}, capacity - seed
    while room > 0:
        length = int(first[room])
        if length:
            used[length] = used.get(length, 0) + 1
        room -= length or 1
    return used


@dataclass
class Program:
    """A fractional solution: ``columns`` (configuration, times), what they leave of each
    length, and ``bound``, the highest dual value met: no solution needs fewer sequences."""

    columns: list[tuple[dict[int, int], float]]
    rest: np.ndarray
    bound: float

    @property
    def sequences(self) -> float:
        return sum(times for _, times in self.columns)


def configuration_program(counts: np.ndarray, capacity: int, bounded: bool = False) -> Program:
    """Solve min sum of x over configurations that cover every length, by multiplicative weights.

    The price of a length is its tokens times exp(-RATE * the share of it covered so far), so
    pricing favours what lags behind and shares rise together. One dynamic program prices
    all sizes, and gives the dearest configuration around every length that is not covered
    yet; each is used until it has covered SHARE of its scarcest length. Divided by the
    dearest configuration's price, prices are a dual solution, whose value bounds the optimum; tokens
    are such prices too, and with ``bounded`` those of every step are tried.
    The program ends when no full configuration can be used, at IDLE prices in a row; what is left is
    for rounding.
    """
    own = np.arange(capacity + 1)
    covered, rest = np.zeros(capacity + 1), counts.astype(float)
    columns: dict[tuple[tuple[int, int], ...], float] = {}
    bound = float((counts * own).sum()) / capacity
    idle = 0
    while idle < IDLE:
        lengths = np.flatnonzero(rest > 1e-6)
        if not len(lengths):
            break
        prices = own * np.exp(-RATE * covered)
        _, first = knapsack(prices, lengths, capacity)
        if bounded:  # of all lengths: covered ones have a price too
            dearest = knapsack(prices, np.flatnonzero(counts), capacity)[0][capacity]
            bound = max(bound, float((counts * prices).sum() / dearest))
        idle += 1
        scarce: set[int] = set()
        for seed in lengths[np.argsort(covered[lengths], kind="stable")].tolist():
            used = configuration(seed, first, capacity)
            if sum(k * n for k, n in used.items()) < capacity:
                continue
            scarce.update(k for k, n in used.items() if n > counts[k])
            step = min(min(SHARE * counts[k], rest[k]) / n for k, n in used.items())
            if step <= 1e-6 or not scarce.isdisjoint(used):
                continue
            for k, n in used.items():
                rest[k] -= step * n
                covered[k] += step * n / counts[k]
            key = tuple(sorted(used.items()))
            columns[key] = columns.get(key, 0.0) + step
            idle = 0
        covered[list(scarce)] += 1 / RATE  # pricing took more of these than there are
    return Program([(dict(key), times) for key, times in columns.items()], rest, bound)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing over a histogram; bins filled alike are counted, not listed."""
    by_room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                used, copies = by_room[room].popitem()
                rooms[room] = bool(by_room[room])
                copies, kept = min(copies, left), copies
                if kept > copies:
                    by_room[room][used] = kept - copies
                    rooms[room] = True
            else:
                room, used, copies = capacity, (), -(-left // (capacity // length))
            by_room[room - length][(*used, length)] = by_room[room - length].get((*used, length), 0) + copies
            rooms[room - length] = True
            left -= copies
    return [
        (np.bincount(used, minlength=capacity + 1), copies) for bins in by_room for used, copies in bins.items()
    ]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with whole numbers of copies that use every piece exactly once: those of
    the program, then those of the few pieces that rounding leaves."""
    made, rest = rounded(counts, capacity)
    return made + best_fit(rest, capacity)


def rounded(counts: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Whole configurations of the program, and the pieces they leave.

    Every column is used as often as its whole part says; then, the largest fractions first, once more
    where its pieces are still there. What is left is a smaller instance, which is
    solved and rounded again until no column of it can be used.
    """
    rest = counts.astype(np.int64).copy()
    made: list[tuple[np.ndarray, int]] = []

    def take(used: dict[int, int], copies: int) -> int:
        copies = min(copies, *(int(rest[k]) // n for k, n in used.items()))
        if copies > 0:
            whole = np.zeros(capacity + 1, np.int64)
            for k, n in used.items():
                rest[k] -= copies * n
                whole[k] = n
            made.append((whole, copies))
        return max(copies, 0)

    if rest[capacity]:
        take({capacity: 1}, int(rest[capacity]))
    while rest.any():
        columns = configuration_program(rest, capacity).columns
        taken = sum(take(used, int(times + 1e-9)) for used, times in columns)
        taken += sum(take(used, 1) for used, _ in sorted(columns, key=lambda c: -(c[1] % 1)))
        if not taken:
            break
    return made, rest


def layout(made: list[tuple[np.ndarray, int]]) -> Layout:
    cursor: dict[int, int] = {}
    keys, sequences, offsets, base = [], [], [], 0
    for used, copies in made:
        offset = 0
        for length in np.flatnonzero(used)[::-1].tolist():
            for _ in range(int(used[length])):
                rank = cursor.get(length, 0)
                keys.append(length << 40 | rank)
                sequences.append(base)
                offsets.append(offset)
                cursor[length] = rank + copies
                offset += length
        base += copies
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return Layout(*(np.array(x, np.int64)[order] for x in (keys, sequences, offsets)), base)


def pieces(docs: DataFrame, vocabulary: str, capacity: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document: piece, start, length, crc32 of
    the ids, the task that cut it and its rank among the task's pieces of that length."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tideline.llm.bpe import WordIds
        from tideline.llm.words import slices

        ids, task = WordIds(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for words in slices(batch.column(1), lower=False, size=RUN_BYTES):
                flat, ends = ids.documents(words)
                flat = flat.astype("<u4", copy=False)
                total = np.diff(ends)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[doc] - start)
                at = (ends[doc] + start).tolist()
                crc = [zlib.crc32(flat[a : a + m]) for a, m in zip(at, length.tolist())]
                order = np.argsort(length, kind="stable")
                kinds, first, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(first, many) + np.repeat(seen[kinds], many)
                seen[kinds] += many
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + words.first)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(doc), task, np.int32)),
                        pa.array(rank),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    )


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the program finds.

    A document is the ids of its text and one closing id. Only longer ones are cut. Returns
    per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null text
    is an empty one (one closing id); rows without or with repeated ids are packed
    like any other; without rows the result is empty.

    The driver sees the histogram (one number per length up to ``capacity``) and answers with
    a layout whose size depends on ``capacity`` alone: configurations times their slots.
    A piece finds its place by its rank among all pieces of its length, which is its rank
    in its task plus what earlier tasks hold; no length is ever gathered in one place.
    """
    cut = written(pieces(docs, vocabulary, capacity, text, doc_id), "pieces")
    per_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    found = cut.sparkSession.sparkContext.broadcast(layout(plan(histogram, capacity)))
    earlier: Column = F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = per_task.select(
        F.col("task").alias("b_task"), F.col("length").alias("b_length"), F.coalesce(earlier, F.lit(0)).alias("before")
    )
    ranked = cut.join(before, (F.col("task") == F.col("b_task")) & (F.col("length") == F.col("b_length"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = found.value.places(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    id_type = docs.schema[doc_id].dataType.simpleString()
    return ranked.mapInArrow(
        place,
        f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
