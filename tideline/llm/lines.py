"""Removal of lines that several documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.columns import SPACES, ascii_lower, fingerprint
from tideline.llm.durable import written

HEAVY = 1000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated_lines(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_docs: int = 2,
    min_chars: int = 10,
) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, except in the smallest id holding them.

    Texts are split at line feeds. A line's key is the line without the ASCII white
    space at both ends, with A-Z in lower case; keys shorter than ``min_chars`` code
    points are left alone. Returns ``row`` (the input row as a struct, whatever its
    columns are called), ``text`` (what is left), ``n_lines`` and ``n_dropped``.

    A null text is one empty line. Rows with one id are one document: they hold
    their lines together and decide on them alike. Rows without an id are together one
    document that comes after all others. Repeated rows stay repeated.

    Lines are compared by a 128-bit hash and counted with partial sums, so a line in
    every document costs one row per task. Only (hash, document, position) meets the
    counts, except for lines that make up more than one in HEAVY of all: these, fewer
    than HEAVY, are broadcast, and their places are dealt by chance instead of by hash.
    Texts are moved once, to their own document's list of positions.
    """
    base = docs.select(
        F.struct("*").alias("row"),
        F.col(doc_id).alias("id"),
        F.xxhash64(F.col(text)).alias("t1"),
        F.xxhash64(F.lit(1), F.col(text)).alias("t2"),
        _lines(F.col(text)).alias("lines"),
    )
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    marks = (
        base.select("id", "t1", "t2", F.posexplode("lines").alias("pos", "line"))
        .select("id", "t1", "t2", "pos", key.alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "t1", "t2", "pos", *fingerprint(F.col("key")))
    )
    holders = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    repeated = written(
        marks.groupBy("h1", "h2")
        .agg(holders.alias("holders"), F.min("id").alias("keeper"), F.count(F.lit(1)).alias("lines"))
        .filter(F.col("holders") >= min_docs)
        .select("h1", "h2", "keeper", "lines"),
        "repeated",
    )
    usual = repeated.agg(F.sum("lines").alias("n")).first()["n"] or 0
    heavy = repeated.filter(F.col("lines") * HEAVY > usual)
    heavy = F.broadcast(heavy.select("h1", "h2", F.struct("keeper").alias("known")))
    elsewhere = F.when(F.col("known").isNull(), F.col("h1")).otherwise(F.xxhash64("t1", "pos", "id"))
    placed = marks.join(heavy, ["h1", "h2"], "left").withColumn("h1", elsewhere)
    found = placed.join(repeated.select("h1", "h2", F.struct("keeper").alias("found")), ["h1", "h2"], "left")
    drops = (
        found.withColumn("said", F.coalesce("known", "found"))
        .filter(F.col("said").isNotNull() & ~F.col("id").eqNullSafe(F.col("said.keeper")))
        .groupBy("id", "t1", "t2")
        .agg(F.collect_set("pos").alias("dropped"))
        .select(F.col("id").alias("d_id"), F.col("t1").alias("d_t1"), F.col("t2").alias("d_t2"), "dropped")
    )
    same = (
        F.col("t1").eqNullSafe(F.col("d_t1"))
        & F.col("t2").eqNullSafe(F.col("d_t2"))
        & F.col("id").eqNullSafe(F.col("d_id"))
    )
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.transform(F.array_except(every, "dropped"), lambda i: F.col("lines")[i])
    return base.join(drops, same, "left").select(
        "row",
        F.array_join(F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(left), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
