"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.durable import discard, written

PLAIN_ROUNDS = 2


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); equal roots mean one component.

    In each round every node moves to the least of its neighbours and itself, nodes
    that moved together become one, and links inside it vanish, until none is left.
    The first rounds order nodes by number, which takes stars to their smallest node
    at once; later ones by a new hash each, so a chain shrinks by a constant factor.
    Minima fold on the map side, so a node with very many links is one row per task.
    """
    forth = links.select("a", "b").filter("a <> b")
    links = written(forth.union(forth.select("b", "a")).distinct(), "links")
    roots = None
    number = 0
    while not links.isEmpty():
        def order(column: str):
            return F.col(column) if number < PLAIN_ROUNDS else F.xxhash64(F.lit(number), F.col(column))

        least = F.min(F.struct(order("b").alias("o"), F.col("b").alias("n")))
        own = F.struct(order("node").alias("o"), F.col("node").alias("n"))
        moves = written(
            links.groupBy(F.col("a").alias("node"))
            .agg(least.alias("least"))
            .select("node", F.when(F.col("least") < own, F.col("least.n")).otherwise(F.col("node")).alias("to")),
            "moves",
        )
        if roots is None:
            found = written(moves.select("node", F.col("to").alias("root")), "roots")
        else:
            step = moves.select(F.col("node").alias("root"), "to")
            found = written(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            discard(roots)
        roots = found
        a, b = (moves.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        fewer = written(
            links.join(a, "a").join(b, "b").filter("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(),
            "links",
        )
        discard(links)
        discard(moves)
        links, number = fewer, number + 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
