"""Mixing sources to target weights by temperature."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.columns import word_count
from tideline.llm.durable import discard, written

SALTS = 64
SECTIONS = 32  # five bisection steps in one pass
PASSES = 8
HIGHEST_EXPONENT = 8.0
BITS = 10
KEY_BITS = 60


@dataclass(frozen=True)
class Mixture:
    """``sources``: one row per source with its weight and budget; ``exponent``: what all weights use."""

    sources: DataFrame
    exponent: float


def order_key(seed: int, block: Column, doc_id: Column) -> Column:
    """Place of a document in the permutation of a block: 60 bits of a hash."""
    label = F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(label), 1, KEY_BITS // 4), 16, 10).cast("long")


def token_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens) with tokens counted as runs of anything but ASCII white space."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("tokens"),
    )


def _bisect(sources: DataFrame, good) -> float:
    """The least exponent in [0, HIGHEST_EXPONENT] for which ``good`` holds; ``good`` is
    an aggregate over sources and holds from some exponent on.

    Every pass tests the inner borders of SECTIONS intervals in one job, which is
    five halvings; only those borders come to the driver.
    """
    low, high = 0.0, HIGHEST_EXPONENT
    for i in range(PASSES):
        step = (high - low) / SECTIONS
        borders = [low + step * k for k in range(0 if i == 0 else 1, SECTIONS)]
        tested = (
            sources.select("*", F.explode(F.array(*map(F.lit, borders))).alias("exponent"))
            .groupBy("exponent")
            .agg(good.alias("good"))
            .filter("good")
            .agg(F.min("exponent").alias("least"))
            .first()["least"]
        )
        if tested == 0.0 and i == 0:
            return 0.0
        high = high if tested is None else tested
        low = low + step * (SECTIONS - 1) if tested is None else high - step
    return high


def mixture(
    tokens: DataFrame,
    max_repeats: float | None = None,
    entropy: float | None = None,
    budget: int | None = None,
    seed: int = 0,
) -> Mixture:
    """Weights share ** exponent, normalised, and the token budget each source gets from them.

    ``tokens`` is a ``token_table``, best one that is stored. Give one target:
    ``max_repeats`` takes the least exponent (the flattest mixture) that repeats no
    source more often than this; ``entropy`` (nats) the one whose weights have that
    entropy, or the nearest possible. ``budget`` is the number of tokens to draw;
    without one it is the smallest that uses every document at least once.

    Sources without any token have no share: weight and budget are zero, and their
    documents are used once. Null is a source of its own. No rows: no sources.

    ``sources`` holds source, tokens, docs, share, weight, budget, blocks (complete
    permutations) and cut (the last place used of one more permutation, or null).
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    totals = written(
        tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")),
        "sources",
    )
    real = totals.filter("tokens > 0")
    whole = real.agg(F.sum("tokens").alias("all"), F.min("tokens").alias("least")).first()
    every = whole["all"] or 0
    share = F.col("tokens") / F.lit(float(max(every, 1)))
    q = real.select("tokens", share.alias("q"))
    power = F.pow("q", F.col("exponent"))
    scale = F.sum(power)
    if entropy is not None:
        reached = F.log(scale) - F.first("exponent") * F.sum(power * F.log("q")) / scale
        good = reached <= entropy
    elif budget is not None:
        good = budget * F.max(power / F.col("tokens")) / scale <= max_repeats
    else:
        slope = F.pow("q", F.col("exponent") - 1)
        good = F.max(slope) / F.min(slope) <= max_repeats
    exponent = 1.0 if not every else round(_bisect(q, good) + 5e-7, 6)
    if entropy is None:
        exponent = min(exponent, 1.0)  # beyond it, large sources would repeat

    power = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent))).otherwise(0.0)
    scale = totals.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    weighted = totals.select("source", "tokens", "docs", share.alias("share"), (power / F.lit(scale)).alias("weight"))
    if budget is None:
        drawn = weighted.agg(F.max(F.col("tokens") / F.nullif("weight", F.lit(0.0))).alias("b")).first()["b"] or 0.0
    else:
        drawn = float(budget)
    planned = weighted.withColumn("budget", F.round(F.col("weight") * F.lit(drawn)).cast("long")).select(
        "*",
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long").alias("blocks"),
    )
    planned = planned.withColumn("rest", F.greatest(F.col("budget") - F.col("blocks") * F.col("tokens"), F.lit(0)))
    cuts = _cuts(tokens, planned, seed)
    same = F.col("source").eqNullSafe(F.col("c_source"))
    sources = written(planned.join(cuts, same, "left").drop("c_source", "rest"), "mixture")
    discard(totals)
    return Mixture(sources, exponent)


def _salted(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Join documents to their source's row; a source with a third of all documents is
    spread over SALTS partitions."""
    spread = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = spread.withColumnRenamed("source", "s_source").withColumnRenamed("salt", "s_salt")
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    on = (F.col("salt") == F.col("s_salt")) & F.col("source").eqNullSafe(F.col("s_source"))
    return salted.join(spread, on).drop("s_source", "salt", "s_salt")


def _cuts(tokens: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """Where the last, incomplete permutation of each source ends.

    The place is found digit by digit: token sums per source and leading bits of the
    place (1,024 rows per source at most), the digit in which the budget runs out, the
    same among its documents, and a running sum over the few that are left.
    """
    wanted = planned.filter("rest > 0").select("source", "blocks", "rest")
    placed = _salted(tokens.filter("tokens > 0"), wanted).select(
        "source", "rest", "tokens", order_key(seed, F.col("blocks"), F.col("doc_id")).alias("place")
    )

    def digit(level: int) -> Column:
        return F.shiftright("place", KEY_BITS - BITS * level).bitwiseAND((1 << BITS) - 1)

    found = None
    for level in (1, 2):
        within = placed
        before = F.lit(0)
        if found is not None:
            within = _salted_on_digit(placed, found, digit(1))
            before = F.col("before")
        sums = within.groupBy("source", "rest", before.alias("before"), digit(level).alias("digit")).agg(
            F.sum("tokens").alias("tokens")
        )
        running = Window.partitionBy("source").orderBy("digit")
        ended = (
            sums.withColumn("upto", F.col("before") + F.sum("tokens").over(running))
            .filter("upto > rest")
            .groupBy("source")
            .agg(F.min(F.struct("digit", (F.col("upto") - F.col("tokens")).alias("before"))).alias("at"))
            .select(F.col("source").alias("f_source"), F.col("at.digit").alias("f_digit"), F.col("at.before").alias("before"))
        )
        if found is None:
            found = first = ended
        else:
            found = ended
    prefix = first.select(F.col("f_source").alias("p_source"), F.col("f_digit").alias("p_digit"))
    lead = prefix.join(found, F.col("p_source").eqNullSafe(F.col("f_source"))).select(
        "f_source", F.shiftleft("p_digit", BITS).bitwiseOR(F.col("f_digit")).alias("f_digit"), "before"
    )
    both = F.shiftright("place", KEY_BITS - 2 * BITS)
    last = _salted_on_digit(placed, lead, both)
    running = Window.partitionBy("source").orderBy("place")
    inside = (
        last.withColumn("upto", F.col("before") + F.sum("tokens").over(running))
        .filter("upto <= rest")
        .groupBy("source")
        .agg(F.max("place").alias("place"))
        .select(F.col("source").alias("i_source"), "place")
    )
    start = F.shiftleft(F.col("f_digit").cast("long"), KEY_BITS - 2 * BITS) - 1
    return lead.join(inside, F.col("f_source").eqNullSafe(F.col("i_source")), "left").select(
        F.col("f_source").alias("c_source"), F.coalesce("place", start).alias("cut")
    )


def _salted_on_digit(placed: DataFrame, found: DataFrame, digit: Column) -> DataFrame:
    on = digit.eqNullSafe(F.col("f_digit")) & F.col("source").eqNullSafe(F.col("f_source"))
    return placed.join(found, on).drop("f_source", "f_digit")


def realise(docs: DataFrame, mixed: Mixture, doc_id: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """The documents the mixture uses, once per block, as ``row`` (the input row as a struct),
    ``block``, ``place`` (the order inside the block), ``weight`` and ``budget`` of the source.

    Every block but a source's last holds all its documents; the last one ends where the
    budget does. Reading blocks in order, and each in the order of ``place``, gives
    every source a fresh permutation per block.
    """
    base = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    joined = _salted(base, mixed.sources.select("source", "weight", "budget", "blocks", "cut"))
    more = F.coalesce(order_key(seed, F.col("blocks"), F.col("doc_id")) <= F.col("cut"), F.lit(False))
    used = F.col("blocks") + more.cast("long")
    blocks = F.when(used > 0, F.sequence(F.lit(0).cast("long"), used - 1)).otherwise(F.array().cast("array<bigint>"))
    return joined.select("row", "doc_id", "source", "weight", "budget", F.explode(blocks).alias("block")).withColumn(
        "place", order_key(seed, F.col("block"), F.col("doc_id"))
    ).drop("doc_id", "source")


MIXING_SQL = """
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents
), s AS (
  SELECT source, sum(tokens)::BIGINT AS total FROM t GROUP BY source
), a AS (
  SELECT sum(total)::DOUBLE AS every, max(total)::DOUBLE AS most, min(total)::DOUBLE AS least FROM s WHERE total > 0
), e AS (
  SELECT every, CASE WHEN most <= least * {repeats} THEN 0.0
         ELSE round(1 - ln({repeats}) / ln(most / least) + 5e-7, 6) END AS exponent FROM a
), w AS (
  SELECT source, total, pow(total / every, exponent) AS p, exponent FROM s, e WHERE total > 0
), z AS (
  SELECT sum(p) AS z FROM w
), b AS (
  SELECT max(total / (p / z)) AS drawn FROM w, z
), g AS (
  SELECT source, total, exponent, p / z AS weight, round(p / z * drawn)::BIGINT AS budget FROM w, z, b
), g2 AS (
  SELECT *, budget // total AS blocks, budget % total AS rest FROM g
), part AS (
  SELECT t.doc_id, t.source, t.tokens, rest,
         ('0x' || substr(md5('{seed}:' || blocks || ':' || t.doc_id), 1, 15))::BIGINT AS place
  FROM t JOIN g2 USING (source)
), cum AS (
  SELECT doc_id, source, sum(tokens) OVER (PARTITION BY source ORDER BY place) <= rest AS inside FROM part
), picked AS (
  SELECT t.doc_id, t.source, t.tokens, unnest(range(blocks + (CASE WHEN inside AND rest > 0 THEN 1 ELSE 0 END))) AS block,
         exponent, weight, budget
  FROM t JOIN g2 USING (source) JOIN cum USING (doc_id)
)
SELECT doc_id, source, tokens, block::BIGINT AS block,
       ('0x' || substr(md5('{seed}:' || block || ':' || doc_id), 1, 15))::BIGINT AS place,
       exponent, round(weight, 9) AS weight, budget
FROM picked
"""
