"""Registered queries over the test tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import (
    cotraining, covertree, graph, html, katz, language, lexical, lines, minhash, mixing, packing, resampling, toxicity,
)
from tideline.llm.durable import let_workers_import, written

MAX_REPEATS = 1.5
SEED = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.classify(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mixture that uses every document and none more than MAX_REPEATS times on average."""
    tokens = written(mixing.token_table(table(spark, sf_dir, "documents")), "tokens")
    mixed = mixing.mixture(tokens, max_repeats=MAX_REPEATS, seed=SEED)
    return mixing.realise(tokens, mixed, seed=SEED).select(
        "row.doc_id", "row.source", "row.tokens", "block", "place",
        F.lit(mixed.exponent).alias("exponent"), F.round("weight", 9).alias("weight"), "budget",
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary, capacity=2048)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_products(table(spark, sf_dir, "embeddings"), every=20, best=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(table(spark, sf_dir, "embeddings"), every=50, best=5)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_html_extraction": op2_html_extraction,
    "op3_katz_backoff": op3_katz_backoff,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_minhash": op6_minhash,
    "op7_cover_tree": op7_cover_tree,
    "op8_toxicity": op8_toxicity,
    "op9_mix_sources": op9_mix_sources,
    "op10_graph_search": op10_graph_search,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_lexical_search": op12_lexical_search,
    "op13_language_id": op13_language_id,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": lines.LINES_SQL,
    "op9_mix_sources": mixing.MIXING_SQL.format(repeats=MAX_REPEATS, seed=SEED),
    "op11_importance_resampling": resampling.RESAMPLING_SQL,
    "op12_lexical_search": lexical.LEXICAL_SQL,
}
