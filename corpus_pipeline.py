"""A training corpus from raw documents: judged, cleaned of repeats, mixed and packed.

Each stage takes what its predecessor kept, acts on all of it, and is written before the
next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import cotraining, lines, minhash, mixing, packing
from tideline.llm.durable import let_workers_import, written
from tideline.llm.queries import MAX_REPEATS, SEED, table

CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Null and empty texts are judged like any other; rows are judged one by one, so repeated
    rows share their fate. No rows, or no labels to learn from: all rows stay.
    """
    return cotraining.accepted(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has; n_chars follows the text.

    A null text becomes the empty one. Rows with one id are one document, rows without
    together one that comes last; all rows stay.
    """
    found = lines.drop_repeated_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    A row is known by its id and its text, so a text stays that shares its id with a copy.
    Rows without an id, and texts without words, are no copies and stay; repeated rows
    of the kept document stay repeated.
    """
    groups = minhash.duplicate_groups(docs).filter("NOT kept")
    gone = groups.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text"))
    same = (docs["doc_id"] == F.col("gone_id")) & (minhash.text_hash("text") == F.col("gone_text"))
    return docs.join(gone.distinct(), same, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and as often as the weight of its source asks for.

    Rows without a source are a source of their own; texts without words weigh nothing and
    stay once. Repeated rows are mixed one by one. No rows: no rows.
    """
    tokens = written(mixing.token_table(docs), "tokens")
    mixed = mixing.mixture(tokens, max_repeats=MAX_REPEATS, seed=SEED)
    return mixing.realise(docs, mixed, seed=SEED).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of CAPACITY tokens.

    A null text is an empty one, which is its end token. Rows are packed one by one, whatever
    their ids. No rows: no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("minhash", near_dedup),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

# SQL can express neither the classifier nor the signatures; tests hold the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
