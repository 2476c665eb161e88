"""Language identification by cross-parsing texts against labelled ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tideline.llm.batches import runs
from tideline.llm.durable import written
from tideline.llm.sampling import fold

FOLDS, HELD_OUT = 4, 2
PASSAGE = 512  # code points of a labelled text that are learned together
PASSAGES = 48  # learned per language
BLOCK = 256  # bytes parsed by themselves
UNKNOWN = "und"
SHARPNESS = 16.0  # bits that make one language twice as likely as another

_SPACE, _BREAK = 32, 0
_FOLDED = np.full(256, _SPACE, np.uint8)  # A-Z lowered; bytes of other letters stay; the rest is space
_FOLDED[97:123] = _FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)
_models: dict[tuple[bytes, ...], Model] = {}


class Model(NamedTuple):
    """One table per language. From state ``s`` (times the number of classes), class ``c`` leads to
    ``table[s + c] >> 2``; the lowest two bits count the phrases that end by reading ``c``."""

    classes: np.ndarray
    tables: list[np.ndarray]
    cost: np.ndarray  # bits that name a phrase in each language's text


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, lower case, with one space for every run of ASCII bytes that are no
    letters, and where each text begins and the last one ends. Each text ends in a space."""
    ended = pc.binary_join_element_wise(pc.utf8_lower(texts), *[pa.scalar(x, pa.large_string()) for x in ("", " ")])
    offsets = np.frombuffer(ended.buffers()[1], np.int64, len(ended) + 1, ended.offset * 8)
    data = _FOLDED[np.frombuffer(ended.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != _SPACE) | (data[:-1] != _SPACE)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], kept[offsets - offsets[0]]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``text``; state 0 starts."""
    steps, link, length, last = [{}], [-1], [0], 0
    for symbol in text:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        state, last = last, new
        while state >= 0 and symbol not in steps[state]:
            steps[state][symbol] = new
            state = link[state]
        if state < 0:
            continue
        target = steps[state][symbol]
        if length[target] == length[state] + 1:
            link[new] = target
            continue
        clone = len(steps)
        steps.append(dict(steps[target]))
        link.append(link[target])
        length.append(length[state] + 1)
        link[target] = link[new] = clone
        while state >= 0 and steps[state].get(symbol) == target:
            steps[state][symbol] = clone
            state = link[state]
    return steps


def build(learned: tuple[bytes, ...]) -> Model:
    """The automata of all languages, over the bytes that any of them uses and one class for the others."""
    used = sorted(set(b"".join(learned)))
    classes = np.full(256, len(used), np.int32)
    classes[used] = np.arange(len(used))
    size = len(used) + 1
    tables, cost = [], []
    for text in learned:
        # numbers below 4 * states * size, for samples of a few million bytes
        steps = suffix_automaton(classes[np.frombuffer(text, np.uint8)].tolist())
        target = np.full((len(steps), size), -1, np.int32)
        for state, out in enumerate(steps):
            target[state, list(out)] = list(out.values())
        # A byte that does not go on ends the phrase and starts the next one, or is one if the text lacks it.
        held = (np.arange(len(steps)) > 0)[:, None].astype(np.int32)
        stuck = np.where(target[0] >= 0, target[0] * size * 4 + held, held + 1)
        table = np.where(target >= 0, target * size * 4, stuck)
        tables.append(table.ravel())
        cost.append(math.log2(len(text) + 1))
    return Model(classes, tables, np.array(cost))


def model(learned: tuple[bytes, ...]) -> Model:
    """Built once in every worker."""
    if learned not in _models:
        _models.clear()
        _models[learned] = build(learned)
    return _models[learned]


def phrases(data: np.ndarray, bounds: np.ndarray, found: Model, block: int = BLOCK) -> np.ndarray:
    """How many phrases of each language's text each text falls into, as texts x languages.

    A phrase is the longest match from where the last one ended, found by following the
    automaton until it has no way on. Texts are parsed in blocks, many side by side.
    """
    size = np.diff(bounds)
    many = -(-size // block)
    owner = np.repeat(np.arange(len(size)), many)
    start = bounds[owner] + block * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    length = np.minimum(bounds[owner + 1] - start, block)
    order = np.argsort(-length, kind="stable")
    owner, start, length = owner[order], start[order], length[order]
    symbols = found.classes[data]
    state = [np.zeros(len(start), table.dtype) for table in found.tables]
    ended = [np.zeros(len(start), np.int64) for _ in found.tables]
    for i in range(int(length[0]) if len(length) else 0):
        going = int(np.searchsorted(-length, -i, "left"))  # blocks with a byte at place i come first
        symbol = symbols[start[:going] + i]
        for table, at, n in zip(found.tables, state, ended):
            step = table[at[:going] + symbol]
            n[:going] += step & 3
            at[:going] = step >> 2
    return np.stack([np.bincount(owner, n + (at > 0), len(size)) for n, at in zip(ended, state)], axis=1)


def learn(docs: DataFrame, text: str, doc_id: str, lang: str, passage: int, passages: int) -> dict[str, bytes]:
    """Per language, most frequent first, the folded text of a sample of ``passages`` distinct passages.

    Every labelled text outside the held-out fold is cut into passages; those of smallest
    hash are taken, so that copies of a text count once and a long one no more than others.
    Each task returns at most that many a language.
    """
    usable = docs.filter((fold(doc_id, FOLDS) != HELD_OUT) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[int, str]] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for at, run in runs(batch.column(1)):
                for name, whole in zip(batch.column(0).slice(at, len(run)).to_pylist(), run.to_pylist()):
                    rows[name] = rows.get(name, 0) + 1
                    held = least.setdefault(name, {})
                    for i in range(0, len(whole), passage):
                        piece = whole[i : i + passage]
                        held[xxh3_64_intdigest(piece.encode()) >> 1] = piece
                        if len(held) > 20 * passages:
                            held = least[name] = _smallest(held, passages)
        for name, held in least.items():
            held = _smallest(held, passages)
            n = pa.array([rows[name]] + [0] * (len(held) - 1), pa.int64())
            columns = [pa.array([name] * len(held)), pa.array(list(held), pa.int64()), pa.array(list(held.values())), n]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "h", "piece", "n"])

    pieces = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    pieces = written(pieces.mapInArrow(sample, "lang string, h long, piece string, n long"), "passages")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    taken = pieces.groupBy("lang", "h").agg(F.first("piece").alias("piece")).withColumn("place", place)
    sampled: dict[str, list[str]] = {}
    for r in taken.filter(F.col("place") <= passages).orderBy("lang", "place").collect():
        sampled.setdefault(r["lang"], []).append(r["piece"])
    rows = pieces.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "lang").collect()
    learned = {}
    for name, _ in rows:
        data, bounds = folded(pa.array(sampled[name], pa.large_string()))
        parts = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        learned[name] = bytes([_BREAK]).join(p for p in parts if p.strip())
    return {k: v for k, v in learned.items() if v}


def _smallest(held: dict[int, str], n: int) -> dict[int, str]:
    return {h: held[h] for h in sorted(held)[:n]}


def identify(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    passage: int = PASSAGE,
    passages: int = PASSAGES,
) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score.

    A suffix automaton is built of a sample of each language's labelled texts, at most
    ``passages`` passages of ``passage`` code points from documents that are not held out. Every
    text is parsed greedily into longest matches with each language. Phrases are normalised
    by the bits it takes to name one, the logarithm of the language's sample size; the
    language that needs least wins, and the more frequent one of two that need the same. The
    score is that language's share when every ``SHARPNESS`` bits more halve a share.

    Null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing
    was learned. Long texts are parsed whole, in blocks. Only the text decides, so repeated
    rows agree; rows without an id are not held out unless the empty id is. Other columns
    are not read.

    Texts are read where they lie. Workers hold one text's run and the automata, whose size
    depends on the sample and the number of languages.
    """
    learned = learn(docs, text, doc_id, lang, passage, passages)
    names, samples = list(learned), tuple(learned.values())
    id_type = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        (fold(doc_id, FOLDS) == HELD_OUT).alias("held_out"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        F.col(text).alias("text"),
    )
    if not names:
        return base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model(samples)
        for batch in batches:
            for at, run in runs(batch.column(3)):
                bits = phrases(*folded(run), found) * found.cost
                least = bits.argmin(axis=1)
                share = 1 / np.exp2((bits.min(axis=1, keepdims=True) - bits) / SHARPNESS).sum(axis=1)
                lettered = batch.column(2).slice(at, len(run))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(run)),
                        batch.column(1).slice(at, len(run)),
                        pc.if_else(lettered, pa.array(names).take(pa.array(least)), UNKNOWN),
                        pc.if_else(lettered, pa.array(share), 0.0),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return base.mapInArrow(parse, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
