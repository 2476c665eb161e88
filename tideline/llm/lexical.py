"""Ranked lexical search: hashed max-sketches bound every score, exact rescoring decides."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.durable import written
from tideline.llm.words import Words, mix, slices

BEST = 50
BLOCK_TERMS = 1 << 18  # terms of the items that one pass over the documents answers
PILOT = 1 / 16  # share of the documents that sets the first thresholds
SPREAD = 32  # coordinates of a sketch for each distinct term of its document, at least
NARROWEST, WIDEST = 64, 1 << 20
CELLS = 1 << 22  # bounds' summands in memory at once
HALF, FULL = 50, 100  # a document of mean length has FULL, an empty one FULL - HALF

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Terms(NamedTuple):
    """Distinct terms of a run of documents, in the documents' order."""

    lengths: np.ndarray  # terms of each document, with repeats
    owners: np.ndarray
    hashes: np.ndarray
    times: np.ndarray


class Block(NamedTuple):
    """The items that one pass answers: item q's terms are ``pairs[starts[q]:starts[q + 1]]``, positions in ``terms``."""

    items: pa.Array
    terms: np.ndarray
    starts: np.ndarray
    pairs: np.ndarray
    present: np.ndarray  # whether some term ends in these sixteen bits


class Measure(NamedTuple):
    """What the corpus gives the score: its documents and terms, and the weights of a block's terms."""

    documents: int
    length: int
    weights: np.ndarray


def document_terms(words: Words) -> Terms:
    lengths = np.diff(words.bounds)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    salted = words.hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))
    found = pa.array(salted).dictionary_encode()
    at, n = found.indices.to_numpy(), len(found.dictionary)
    owners, hashes = np.empty(n, np.int64), np.empty(n, np.uint64)
    owners[at], hashes[at] = owner, words.hashes
    return Terms(lengths, owners, hashes, np.bincount(at, minlength=n))


def make_block(items: pa.Array, terms: list[np.ndarray]) -> Block:
    vocabulary, pairs = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]), return_inverse=True)
    present = np.zeros(1 << 16, bool)
    present[vocabulary & np.uint64(0xFFFF)] = True
    return Block(items, vocabulary, np.cumsum([0, *map(len, terms)]), pairs, present)


def asked(block: Block, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Which of the documents' terms a block asks for, and their positions in it."""
    rough = np.flatnonzero(block.present[terms.hashes & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(block.terms, terms.hashes[rough]), len(block.terms) - 1)
    same = block.terms[at] == terms.hashes[rough]
    return rough[same], at[same]


class Sketches:
    """One vector of maxima per document. A term's coordinate is its hash modulo the width,
    a power of two that grows with the document; there the sketch is at least its impact."""

    def __init__(self, terms: Terms, impacts: np.ndarray):
        distinct = np.bincount(terms.owners, minlength=len(terms.lengths))
        width = 1 << np.ceil(np.log2(np.maximum(SPREAD * distinct, 1))).astype(np.int64)
        width = np.clip(width, NARROWEST, WIDEST)
        self.first = np.cumsum(width) - width
        self.mask = width - 1
        self.flat = np.zeros(int(width.sum()), np.int32)
        place = (terms.hashes & self.mask.astype(np.uint64)[terms.owners]).astype(np.int64) + self.first[terms.owners]
        np.maximum.at(self.flat, place, impacts.astype(np.int32))

    def bounds(self, block: Block, weights: np.ndarray) -> np.ndarray:
        """For each document and item, what the score of the one for the other cannot exceed."""
        low = (block.terms & np.uint64(WIDEST - 1)).astype(np.int64)
        found = self.flat[(low[None, :] & self.mask[:, None]) + self.first[:, None]]
        return np.add.reduceat(found[:, block.pairs] * weights[block.pairs], block.starts[:-1], axis=1)


class Exact:
    """Impacts of the terms asked for, to score single pairs of a document and an item."""

    def __init__(self, block: Block, weights: np.ndarray, terms: Terms, impacts: np.ndarray):
        mine, at = asked(block, terms)
        key = terms.owners[mine] * len(block.terms) + at
        order = np.argsort(key, kind="stable")
        self.key, self.gain = key[order], (impacts[mine] * weights[at])[order]
        self.block = block

    def scores(self, documents: np.ndarray, items: np.ndarray) -> np.ndarray:
        starts, size = self.block.starts, len(self.block.terms)
        many = starts[items + 1] - starts[items]
        begin = np.cumsum(many) - many
        pair = np.arange(int(many.sum())) - np.repeat(begin - starts[items], many)
        key = np.repeat(documents, many) * size + self.block.pairs[pair]
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        gain = np.where(self.key[at] == key, self.gain[at], 0) if len(self.key) else np.zeros(len(key), np.int64)
        return np.add.reduceat(gain, begin)


class Leaders:
    """The best documents so far of every item, in rank order, and the score that another must reach."""

    def __init__(self, floors: np.ndarray, best: int):
        self.floors, self.best = np.maximum(floors, 1), best
        self.rows = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # item, score, id, id is null

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= self.floors[items]
        if not good.any():
            return
        item, score, number, null = (np.concatenate([a, b[good]]) for a, b in zip(self.rows, (items, scores, ids, nulls)))
        order = np.lexsort((number, null, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[place < self.best]
        self.rows = [item[order], score[order], number[order], null[order]]
        last = place[place < self.best] == self.best - 1
        np.maximum.at(self.floors, self.rows[0][last], self.rows[1][last])


def _impacts(terms: Terms, measure: Measure) -> np.ndarray:
    norm = FULL - HALF + HALF * terms.lengths * measure.documents // measure.length
    return 1_000_000_000 * terms.times // (1000 * terms.times + 20 * norm[terms.owners])


def _part(terms: Terms, first: int, last: int) -> Terms:
    """The documents ``first`` to ``last``, numbered anew."""
    a, b = np.searchsorted(terms.owners, [first, last])
    return Terms(terms.lengths[first:last], terms.owners[a:b] - first, terms.hashes[a:b], terms.times[a:b])


def search(terms: Terms, ids: np.ndarray, nulls: np.ndarray, block: Block, measure: Measure, leaders: Leaders) -> None:
    """Let a run of documents compete for the places of all items of a block.

    Pairs whose bound reaches an item's floor are scored from the highest bound on; each
    round raises the floors, and stops an item once its next bound is below its floor.
    """
    step = max(1, CELLS // max(len(block.pairs), 1))
    for i in range(0, len(terms.lengths), step):
        part = _part(terms, i, i + step)
        impacts = _impacts(part, measure)
        exact = Exact(block, measure.weights, part, impacts)
        bound = Sketches(part, impacts).bounds(block, measure.weights)
        row, item = np.nonzero(bound >= leaders.floors)
        order = np.lexsort((-bound[row, item], item))
        row, item = row[order], item[order]
        turn = leaders.best
        while len(item):
            now = np.arange(len(item)) - np.searchsorted(item, item) < turn
            d, q = row[now], item[now]
            leaders.add(q, exact.scores(d, q), ids[i + d], nulls[i + d])
            row, item = row[~now], item[~now]
            left = bound[row, item] >= leaders.floors[item]
            row, item, turn = row[left], item[left], 2 * turn


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Terms, np.ndarray, np.ndarray]]:
    for batch in batches:
        known = batch.column(0).cast(pa.int64())
        ids, nulls = known.fill_null(0).to_numpy(), known.is_null().to_numpy(zero_copy_only=False)
        for words in slices(batch.column(1), outside=_OUTSIDE):
            terms = document_terms(words)
            part = slice(words.first, words.first + len(terms.lengths))
            yield terms, ids[part], nulls[part]


def _measure(texts: DataFrame, block: Block) -> Measure:
    """Counts over all documents; the driver sees one row per term of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, documents, length = np.zeros(len(block.terms), np.int64), 0, 0
        for terms, _, _ in _runs(batches):
            holders += np.bincount(asked(block, terms)[1], minlength=len(block.terms))
            documents += int((terms.lengths > 0).sum())
            length += int(terms.lengths.sum())
        held = np.flatnonzero(holders)
        kinds = np.concatenate([held, [-1, -2]])
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([*holders[held].tolist(), documents, length], pa.int64())], ["term", "n"])

    sums = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}
    documents, length = found.get(-1, 0), found.get(-2, 0)
    holders = np.array([found.get(t, 0) for t in range(len(block.terms))], np.float64)
    weights = np.floor(1000 * np.log((2.0 * documents + 2) / (2 * holders + 1))).astype(np.int64)
    return Measure(documents, length, weights)


def _compete(texts: DataFrame, block: Block, measure: Measure, floors: np.ndarray, best: int, id_type: str) -> DataFrame:
    """(query, doc_id, score) of each task's best documents that reach the floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = Leaders(floors.copy(), best)
        for terms, ids, nulls in _runs(batches):
            search(terms, ids, nulls, block, measure, leaders)
        item, score, number, null = leaders.rows
        ids = pa.array(number, mask=null).cast(texts_type)
        yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(score)], ["query", "doc_id", "score"])

    texts_type = pa.int64() if id_type == "bigint" else pa.int32()
    found = texts.mapInArrow(run, f"query long, doc_id {id_type}, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def _items(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """(item_id, terms, number) of the items that have terms, repeated rows one by one."""
    id_type = items.schema[item_id].dataType.simpleString()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(1), outside=_OUTSIDE):
                terms = document_terms(words)
                ends = np.cumsum(np.bincount(terms.owners, minlength=len(terms.lengths)))
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(terms.hashes.view(np.int64)))
                ids = batch.column(0).slice(words.first, len(ends))
                yield pa.RecordBatch.from_arrays([ids, lists.cast(pa.list_(pa.int64()))], ["item_id", "terms"])

    found = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    found = found.mapInArrow(distinct, f"item_id {id_type}, terms array<long>").filter(F.size("terms") > 0)
    return written(found.withColumn("number", F.monotonically_increasing_id()), "items")


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    best: int = BEST,
    block_terms: int = BLOCK_TERMS,
    pilot: float = PILOT,
) -> DataFrame:
    """The ``best`` highest-scoring documents of every item: item_id, rank, doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lowered. A term that
    df of the N documents with terms hold weighs floor(1000 ln((2N + 2) / (2 df + 1))); times
    its damped frequency in a document of that length, summed over the item's distinct terms,
    it makes the score. Only scores above 0 count; equal ones go by id.

    Null and empty texts match nothing, and items without terms return no rows. Ids are whole
    numbers; rows without one come last among equal scores. Rows that share an id
    compete one by one, and items that share an id are answered one by one. No rows: no rows.

    Each document folds the impacts of its terms into a vector of maxima whose width grows
    with it. All items of a block look their terms up in it at once, which bounds their scores,
    and exact scores are taken from the highest bound on until no bound reaches the floor. The
    floors start at the scores that a share ``pilot`` of the documents reaches, which holds for
    all of them, so that a pass returns about best / pilot rows an item however many tasks it
    has. Items are answered in blocks of about ``block_terms`` terms; texts never move.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked_for = _items(items, item_text, item_id)
    item_type = asked_for.schema["item_id"].dataType.simpleString()
    total = asked_for.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_terms))
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    for b in range(blocks):
        mine = asked_for.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).toArrow()
        if not len(mine):
            continue
        lists = mine["terms"].combine_chunks()
        terms = [np.asarray(lists[i].values).view(np.uint64) for i in range(len(lists))]
        block = make_block(mine["item_id"].combine_chunks(), terms)
        measure = _measure(texts, block)
        if not measure.length:
            return out
        floors = np.zeros(len(terms), np.int64)
        first = _compete(texts.filter(F.rand(11) < pilot), block, measure, floors, best, id_type)
        for row in first.filter(F.col("rank") == best).select("query", "score").collect():  # one row an item
            floors[row["query"]] = row["score"]
        found = _compete(texts, block, measure, floors, best, id_type)
        names = spark.createDataFrame(pa.table({"query": pa.array(range(len(terms)), pa.int64()), "item_id": block.items}))
        named = found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = out.unionByName(written(named, "found")) if blocks > 1 else named
    return out


LEXICAL_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
), t AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL
), f AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, docs
), m AS (
  SELECT doc_id, 50 + (50 * len(terms) * docs) // total AS m FROM d, s
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
