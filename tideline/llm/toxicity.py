"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.sampling import fold, sampled

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
MOST_POSITIVE = 6_000  # bounds of the training sample
MOST_UNLABELLED = 12_000
SPACE = 1 << 32
SIEVE = 1 << 20
PREFIXES = (4, 5, 6)
USUAL_LENGTH = 2_000  # letter runs; beyond it, repeated occurrences count by their rate
LEVELS = ((1, 0), (2, 0x3C6EF362), (4, 0x78DDE6C4))  # occurrences, and what marks a feature reached so often
KEPT_FEATURES = 4_096
LEAST_Z = 6.0  # a million features reach 5 by chance
STEPS = 250
RATE = 0.1
DECAY = 1e-4

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


@dataclass(frozen=True)
class PuModel:
    """``weights`` of hashed ``features``, ascending; score = logistic(bias + sum over a text's distinct features)."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def features(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) of every letter run in the slice and of its first 4, 5 and 6 bytes, A-Z
    in lower case; and per text how often counts above one must be reached, more in longer texts."""
    from tideline.llm.words import hash_spans, spans

    starts, ends = spans(words.buffer, ~_LETTERS)
    text = np.searchsorted(words.offsets, starts, "right") - 1
    scale = np.maximum(np.bincount(text, minlength=len(words.bounds) - 1) / USUAL_LENGTH, 1.0)
    texts, found = [text], [hash_spans(words.buffer, starts, ends) % np.uint64(SPACE)]
    for k, n in enumerate(PREFIXES):
        long = ends - starts > n
        h = hash_spans(words.buffer, starts[long], starts[long] + n)
        texts.append(text[long])
        found.append((h ^ np.uint64(0x9E37 * (k + 1))) % np.uint64(SPACE))
    return np.concatenate(texts), np.concatenate(found).astype(np.uint32), scale


def levelled(texts: np.ndarray, found: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """text * SPACE + feature, distinct and ascending, with a feature of its own for being
    found twice and four times: a stem that clean texts hit by chance is dense in toxic ones.

    Whatever occurs counts at the first level; only the levels above go by the rate in long texts."""
    pairs, times = np.unique(texts * SPACE + found, return_counts=True)
    rate = times / scale[pairs // SPACE]
    return np.sort(np.concatenate([pairs[rate >= least] ^ mark if mark else pairs for least, mark in LEVELS]))


def feature_rows(docs: DataFrame) -> DataFrame:
    """(kind, distinct features as 32-bit numbers) of the texts of ``docs`` (kind, text)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tideline.llm.words import slices

        for batch in batches:
            for words in slices(batch.column(1)):
                text, found, scale = features(words)
                n = len(words.bounds) - 1
                pairs = levelled(text, found, scale)
                at = np.searchsorted(pairs, np.arange(n + 1) * SPACE)
                ids = (pairs % SPACE).astype(np.uint32)
                rows = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, n), pa.array(rows, pa.binary())], ["kind", "features"]
                )

    return docs.select("kind", "text").mapInArrow(extract, "kind int, features binary")


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> PuModel:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss.

    When the corrected negative risk falls below zero the step goes up its gradient
    instead, so the model cannot explain the unlabelled texts away. Features are
    those more frequent in the examples by LEAST_Z standard errors, at most the
    KEPT_FEATURES that differ most.
    """
    none = np.zeros(0, np.uint32)
    if not positive or not unlabelled:
        return PuModel(none, np.zeros(0), -30.0 if not positive else 0.0, prior)
    n_p, n_u = len(positive), len(unlabelled)
    (ids_p, in_p), (ids_u, in_u) = (np.unique(np.concatenate(x), return_counts=True) for x in (positive, unlabelled))
    at = np.minimum(np.searchsorted(ids_u, ids_p), max(len(ids_u) - 1, 0))
    in_u = np.where(ids_u[at] == ids_p, in_u[at], 0) if len(ids_u) else np.zeros(len(ids_p), np.int64)
    share = (in_p + in_u) / (n_p + n_u)
    spread = np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u)) + 1e-12
    z = np.where(in_p + in_u >= 3, (in_p / n_p - in_u / n_u) / spread, 0)
    kept = np.sort(ids_p[np.argsort(-z, kind="stable")[: min(KEPT_FEATURES, int((z >= LEAST_Z).sum()))]])
    found = [np.flatnonzero(np.isin(kept, x, assume_unique=True)) for x in (*positive, *unlabelled)]
    rows, cols = np.repeat(np.arange(n_p + n_u), [len(x) for x in found]), np.concatenate(found)

    w, bias = np.zeros(len(kept)), np.log(prior / (1 - prior))
    first, second = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    is_p = np.arange(n_p + n_u) < n_p
    for step in range(1, STEPS + 1):
        f = np.bincount(rows, w[cols], minlength=n_p + n_u) + bias
        s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        negative = np.logaddexp(0, f)
        corrected = negative[~is_p].mean() - prior * negative[is_p].mean()
        if corrected >= 0:
            slope = np.where(is_p, prior * (s - 1) / n_p - prior * s / n_p, s / n_u)
        else:
            slope = -np.where(is_p, -prior * s / n_p, s / n_u)
        gradient = np.append(np.bincount(cols, slope[rows], minlength=len(kept)) + DECAY * w, slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        change = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
    return PuModel(kept, w, float(bias), prior)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> PuModel:
    """A model from rows outside the held-out fold: confirmed examples are those labelled 1,
    all texts count as unlabelled, the examples too. The class prior is the labelled rows' share of 1.

    The sample is bounded by MOST_POSITIVE and MOST_UNLABELLED texts, so the ids of its
    examples can be broadcast; counts and prior are of all rows.
    """
    learned = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isNotNull() & F.col("id").isNotNull() & (fold("id", FOLDS) != HELD_OUT)
    )
    known = learned.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(fold("id", FOLDS) != HELD_OUT)
    confirmed = sampled(learned.filter("label = 1").select("id").distinct(), "id", MOST_POSITIVE, known["ones"], 1)
    others = sampled(base, "id", MOST_UNLABELLED, base.count(), 2)
    sample = (
        base.join(F.broadcast(confirmed), "id").select(F.lit(1).alias("kind"), "text")
        .unionByName(others.select(F.lit(0).alias("kind"), "text"))
    )
    sides: tuple[list, list] = ([], [])
    for row in feature_rows(sample).toLocalIterator():
        sides[row["kind"]].append(np.frombuffer(row["features"], np.uint32))
    prior = min(max(known["ones"] / max(known["n"], 1), 1e-3), 0.5)
    return fit_nnpu(sides[1], sides[0], prior)


def score(docs: DataFrame, model: PuModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts have no feature and score the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tideline.llm.words import slices

        model = shared.value
        sieve = np.zeros(SIEVE, bool)
        sieve[model.features % SIEVE] = True
        for batch in batches:
            for words in slices(batch.column(1)):
                texts, found, scale = features(words)
                n = len(words.bounds) - 1
                maybe = np.logical_or.reduce([sieve[(found ^ np.uint32(mark)) % SIEVE] for _, mark in LEVELS])
                pairs = levelled(texts[maybe], found[maybe], scale)
                texts, found = pairs // SPACE, pairs % SPACE
                at = np.searchsorted(model.features, found)
                known = at < len(model.features)
                known[known] = model.features[at[known]] == found[known]
                f = np.bincount(texts[known], model.weights[at[known]], minlength=n) + model.bias
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, n), pa.array(1 / (1 + np.exp(-np.clip(f, -40, 40))))],
                    ["doc_id", "score"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        apply, f"doc_id {kind}, score double"
    )


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted (score >= THRESHOLD) for every row.

    Only texts enter a score. Without any confirmed example every score is about 0;
    with examples but no other text it is one half. Null labels teach nothing; rows without
    an id are scored and count as unlabelled; repeated rows are scored alike.
    """
    found = score(docs, train(docs, labels, text, doc_id), text, doc_id)
    return found.select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
