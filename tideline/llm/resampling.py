"""Importance resampling towards a target corpus over hashed word n-grams, on Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.batches import runs
from tideline.llm.durable import written
from tideline.llm.ranks import numbered

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates the words of a lower-cased text

_POLYNOMIAL = 0xEDB88320


class Features(NamedTuple):
    """Buckets of the word n-grams of a run of texts, by the place of their first word."""

    counts: np.ndarray  # words of each text
    single: np.ndarray  # bucket of every word
    pairs: np.ndarray  # bucket of every pair of neighbours
    first: np.ndarray  # place of each pair's first word


def _next_byte(register: np.ndarray) -> np.ndarray:
    """crc32 registers after one more zero byte."""
    for _ in range(8):
        register = (register >> np.uint32(1)) ^ (register & np.uint32(1)) * np.uint32(_POLYNOMIAL)
    return register


def _applied(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its images of the single bits, applied to all of ``x``."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= (x >> np.uint32(bit) & np.uint32(1)) * images[bit]
    return out


def appended(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """crc32 of joined byte strings from those of their parts and the length of the right ones.

    Appending n bytes sends the left register through n steps of zero bytes, a linear map.
    It is built by repeated squaring for each length that occurs and looked up byte by byte.
    """
    lengths, which = np.unique(right_bytes, return_inverse=True)
    single = np.uint32(1) << np.arange(32, dtype=np.uint32)
    values = (np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
    squares = [_next_byte(single)]
    tables = np.empty((len(lengths), 4 * 256), np.uint32)
    for i, length in enumerate(lengths.tolist()):
        images, bit = single, 0
        while length >> bit:
            if bit == len(squares):
                squares.append(_applied(squares[-1], squares[-1]))
            if length >> bit & 1:
                images = _applied(squares[bit], images)
            bit += 1
        tables[i] = _applied(images, values)
    out = right.copy()
    for byte in range(4):
        out ^= tables[which, 256 * byte + (left >> np.uint32(8 * byte) & np.uint32(255))]
    return out


def _checksums(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """crc32 and length in bytes of every word."""
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    held, at = memoryview(words.buffers()[2] or b""), ends.tolist()
    return np.fromiter((crc32(held[a:b]) for a, b in zip(at, at[1:])), np.uint32, len(words)), np.diff(ends)


def features(texts: pa.Array, buckets: int = BUCKETS) -> Features:
    """The hashed words and pairs of neighbouring words of some texts.

    Words become dictionary indices, two shifted views of which form the pairs. Only
    distinct words and distinct pairs meet crc32.
    """
    split = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    words, parents = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(real).dictionary_encode(), parents.filter(real).to_numpy()
    hashes, lengths = _checksums(words.dictionary)
    space = np.full(len(hashes), crc32(b" "), np.uint32)
    spaced = appended(hashes, space, np.ones(len(hashes), np.int64))
    index = words.indices.to_numpy().astype(np.int64)

    first = np.flatnonzero(parents[1:] == parents[:-1])
    size = max(len(hashes), 1)
    pairs = pa.array(index[first] * size + index[first + 1]).dictionary_encode()
    left, right = np.divmod(pairs.dictionary.to_numpy(), size)
    joined = appended(spaced[left], hashes[right], lengths[right])
    bucket = lambda found, indices: (found % np.uint32(buckets)).astype(np.int64)[indices]
    return Features(
        np.bincount(parents, minlength=len(texts)).astype(np.int64),
        bucket(hashes, index),
        bucket(joined, pairs.indices.to_numpy()),
        first,
    )


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one sum per task, added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, run in runs(batch.column(0)):
                found = features(run, buckets)
                total += np.bincount(found.single, minlength=buckets) + np.bincount(found.pairs, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])

    partial = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(spark, raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of a bucket's share in the target over its share in the raw texts, floored."""
    held = [(i, int(s), int(t)) for i, (s, t) in enumerate(zip(raw, target))]
    all_raw, all_target = F.lit(float(raw.sum() + len(raw))), F.lit(float(target.sum() + len(raw)))
    ratio = ((F.col("t") + 1).cast("double") * all_raw) / ((F.col("s") + 1).cast("double") * all_target)
    found = spark.createDataFrame(held, "bucket long, s long, t long").select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))
    gains = np.zeros(len(raw), np.int64)
    for row in found.collect():
        gains[row["bucket"]] = row["gain"]
    return gains


def weighted(docs: DataFrame, gains: np.ndarray, text: str, doc_id: str) -> DataFrame:
    """Per row: doc_id, n_words, n_features and weight, the floored mean gain of the row's features."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in runs(batch.column(1)):
                found = features(run, len(gains))
                gained = gains[found.single]
                gained[found.first] += gains[found.pairs]
                ends = np.cumsum(found.counts)
                sums = np.concatenate([[0], np.cumsum(gained)])
                n = found.counts + np.maximum(found.counts - 1, 0)
                total = sums[ends] - sums[ends - found.counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(run)), pa.array(found.counts), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        weigh, f"doc_id {id_type}, n_words long, n_features long, weight long"
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Draw ``percent`` of the documents, without replacement, by their likeness to the target texts.

    Features are words and pairs of neighbouring words, hashed into ``buckets``. A document's
    weight is the floored mean gain of its features; a Gumbel number made of ``seed`` and its
    id is added, and the highest sums among documents of at least ``min_words`` words are
    drawn. Returns doc_id, n_features, weight, score and rank, null where not drawn.

    Null and empty texts have no features and weight 0. A row without an id draws the number
    of the empty id and comes last among equal scores. Repeated rows are drawn one by one; rows
    with one id share its number. An empty target leaves every gain to the raw texts; no
    rows: no rows. Other columns are not read.

    The driver sees one number per bucket. Texts are read twice, never moved; the
    ranking moves five numbers per document.
    """
    spark = docs.sparkSession
    gains = bucket_gains(spark, bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    gumbel = F.floor(-1000 * F.ln(-F.ln(uniform)))
    scored = written(
        weighted(docs, gains, text, doc_id).select(
            "doc_id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), (F.col("n_words") < min_words).alias("short")
        ),
        "scored",
    )
    draws = scored.filter("NOT short").count() * percent // 100
    order = [F.col("short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    drawn = ~F.col("short") & (F.col("place") <= draws)
    return numbered(scored, order, "place").select(
        "doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank")
    )


# crc32 byte by byte from its table of 256 entries, made by the same rule
RESAMPLING_SQL = """
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), bytes AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), texts AS (
  SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM texts
), f AS (
  SELECT side, id, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w
), g AS (
  SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL
), hashed AS (
  SELECT feature, xor(list_reduce(
           [4294967295::BIGINT] || list_transform(range(0, octet_length(encode(feature))),
             lambda i: ('0x' || substr(hex(encode(feature)), (2 * i + 1)::BIGINT, 2))::BIGINT),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM g), bytes
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
  FROM g JOIN hashed USING (feature) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM counts)::DOUBLE
                     / ((s + 1)::DOUBLE * (SELECT sum(t) + 10000 FROM counts)::DOUBLE)))::BIGINT AS gain
  FROM counts
), weights AS (
  SELECT id, sum(n) AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
  FROM g JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 's' GROUP BY id
), scored AS (
  SELECT w.id AS doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, len(words) < 20 AS short,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weights ON weights.id = w.id WHERE side = 's'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY short ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY short) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN NOT short AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""
