"""Near-duplicate documents: circulant MinHash, banding, and a check on full sets."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import connected
from tideline.llm.durable import discard, written

WIDTH = 5
PERCENT = 75
BANDS = 36
ROWS = 4
POSITIONS = 1 << 20
BITS = 8  # of a set's bitmap for each of its shingles, at least
SMALLEST, LARGEST = 1 << 9, 1 << 17
WORTHWHILE = 20  # star rounds go on while one in so many pairs is a link
HEAVY = 1000  # sets that more than one in so many documents hold are joined apart
_WEIGHTS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Per text its set of word shingles, as sorted 64-bit numbers. A text of fewer words
    is one shingle of its own length; one without words has none."""
    from tideline.llm.words import mix

    h = words.hashes
    n = max(len(h) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += h[k : k + n] * _WEIGHTS[k]
    rolled = mix(rolled)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = (h[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_number(found: np.ndarray) -> int:
    """A 64-bit fingerprint of a set, 0 for the empty one."""
    from tideline.llm.words import mix

    total = mix(found ^ _WEIGHTS[42]).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total).view(np.int64)[0]) if len(found) else 0


def circulant(shifts: int) -> np.ndarray:
    """Row p holds the second permutation read from position p on: the ``shifts``
    coordinates of an element that the first permutation sends to p."""
    second = np.random.default_rng(7).permutation(POSITIONS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: shifts - 1]]), shifts)


def signature(found: np.ndarray, shifted: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Hashes of the bands of one set's signature.

    The first permutation is a hash of the element, taken as a position; coordinate k is
    the least entry, over the set, of the second permutation shifted by k.
    """
    from tideline.llm.words import mix

    at = (mix(found ^ _WEIGHTS[40]) % np.uint64(POSITIONS)).astype(np.int64)
    least = shifted[at[:4096]].min(axis=0)
    for i in range(4096, len(at), 4096):
        np.minimum(least, shifted[at[i : i + 4096]].min(axis=0), out=least)
    grid = least.reshape(bands, rows).astype(np.uint64)
    return mix(grid @ _WEIGHTS[:rows] + np.arange(bands, dtype=np.uint64) * _WEIGHTS[41])


def bitmap(found: np.ndarray) -> np.ndarray:
    """Which residues of the shingles occur, modulo a power of two that grows with the set."""
    wide = 1 << max(BITS * len(found) - 1, 1).bit_length()
    wide = min(max(wide, SMALLEST), LARGEST)
    held = np.zeros(wide, bool)
    held[(found & np.uint64(wide - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view(np.int64)


def signatures(docs: DataFrame, text: str, doc_id: str, bands: int, rows: int) -> DataFrame:
    """Per row: text_hash, n_shingles, a 64-bit fingerprint of its set (``node``) and its band keys."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tideline.llm.words import slices

        shifted = circulant(bands * rows)
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for words in slices(batch.column(2)):
                sizes, nodes, keys = [], [], []
                for found in shingle_sets(words):
                    sizes.append(len(found))
                    nodes.append(set_number(found))
                    keys.append(signature(found, shifted, bands, rows) if len(found) else none)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, len(sizes)),
                        batch.column(1).slice(words.first, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.int64()),
                        _lists(keys),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "node", "bands"],
                )

    rows_of = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    return rows_of.mapInArrow(sign, f"doc_id {id_type}, text_hash long, n_shingles long, node long, bands array<long>")


def text_hash(text: str) -> Column:
    """What tells texts of one id apart; null and empty are not the same here."""
    return F.xxhash64(F.col(text))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).view(np.int64)))


def _halved(bits: Column, other: Column) -> Column:
    """A bitmap folded to the size of one half as wide; one of equal or smaller size as it is."""
    half = (F.size(bits) / 2).cast("int")
    either = F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(bits) > F.size(other), either).otherwise(bits)


def _may_be_similar(a: str, b: str, percent: int) -> Column:
    """Whether two sets of sizes ``a_n`` and ``b_n`` can be similar enough, given their bitmaps.

    A residue that only one set has stands for at least one shingle the other lacks, which
    bounds the intersection from above: no similar pair is ruled out.
    """
    a_bits, b_bits = F.col(f"{a}_bits"), F.col(f"{b}_bits")

    def lacking(x: Column, y: Column) -> Column:
        alone = F.zip_with(_halved(x, y), _halved(y, x), lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j))))
        return F.aggregate(alone, F.lit(0), lambda total, n: total + n)

    common = F.least(F.col(f"{a}_n") - lacking(a_bits, b_bits), F.col(f"{b}_n") - lacking(b_bits, a_bits))
    return 100 * common >= percent * (F.col(f"{a}_n") + F.col(f"{b}_n") - common)


def _sets(texts: DataFrame) -> DataFrame:
    """(node, items, bits): the shingles of each node's set as bytes, and their bitmap, from texts that may have it."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tideline.llm.words import slices

        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for words in slices(batch.column(1)):
                found = list(zip(nodes[words.first :], shingle_sets(words)))
                found = [(node, items) for node, items in found if set_number(items) == node]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n for n, _ in found], pa.int64()),
                        pa.array([i.tobytes() for _, i in found], pa.binary()),
                        _lists([bitmap(i) for _, i in found]),
                    ],
                    ["node", "items", "bits"],
                )

    return texts.select("node", "text").mapInArrow(gather, "node long, items binary, bits array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "a_items", "b_items")
    return joined.mapInArrow(compare, "a long, b long")


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of buckets that hold several components, each with its own root and ``top``,
    that of the bucket's largest component."""
    if roots is None:
        placed = members.withColumn("root", F.col("node"))
    else:
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed")
    by_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many"))
    mixed = (
        by_root.groupBy("key")
        .agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("many", "root")).alias("top"))
        .filter("roots > 1")
        .select("key", F.col("top.root").alias("top"))
    )
    return written(placed.join(mixed, "key"), "open")


def _sides(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _star(open_: DataFrame, number: int, percent: int) -> DataFrame:
    """Distinct pairs of a hub, one per bucket, and the bucket's members of other components."""
    order = F.col("mates") if number == 0 else F.xxhash64(F.lit(number), F.col("node"))
    hubs = open_.groupBy("key").agg(F.max(F.struct(order.alias("o"), "node", "n", "root")).alias("hub"))
    met = open_.join(hubs, "key").filter(F.col("root") != F.col("hub.root"))
    met = met.select(F.col("node").alias("x"), F.col("n").alias("a_n"), F.col("hub.node").alias("y"), F.col("hub.n").alias("b_n"))
    return met.filter(_near_in_size(percent)).select(*_sides("x", "y")).distinct()


def _near_in_size(percent: int) -> Column:
    return 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")


def _rest(open_: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of nodes of different components that may be similar, once: in the first band they share."""
    known = open_.join(classes.select("node", "bands"), "node").join(sets.select("node", "bits"), "node")
    known = written(known.select("key", "band", "node", "n", "root", "top", "bands", "bits"), "known")
    x, y = (known.select(*(F.col(c).alias(f"{side}_{c}") for c in known.columns)) for side in "ab")
    x = x.filter("a_root <> a_top")
    other = (F.col("a_key") == F.col("b_key")) & (F.col("a_root") != F.col("b_root"))
    once = (F.col("b_root") == F.col("b_top")) | (F.col("a_node") < F.col("b_node"))
    earlier = F.arrays_overlap(F.slice("a_bands", 1, F.col("a_band")), F.slice("b_bands", 1, F.col("a_band")))
    on = other & once & _near_in_size(percent) & ~earlier & _may_be_similar("a", "b", percent)
    return x.join(y, on).select(*_sides("a_node", "b_node"))


def duplicate_groups(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable
    over links), kept (it is that id) and text_hash, which tells rows of one id apart.

    Two documents are linked if their sets of distinct 5-word shingles satisfy
    100 * intersection >= percent * union. A pair at the limit of 0.75 shares no band
    with a chance of (1 - 0.75 ** 4) ** 36, about one in a million; every pair found is
    checked on its full sets.

    Documents with equal sets are one node. In a bucket each node is first checked against
    a hub, the one with most bucket mates, and, while that goes on linking, against
    others drawn by lot; nodes connected meanwhile need no further pair, so a bucket of n
    copies costs about n pairs. Between nodes of a bucket that are still in different
    components every pair is checked, once, in the first band both share, unless their sizes
    or bitmaps already prove it too different.

    Null and empty texts have no shingles and are linked with nothing. Rows without an id
    have a null component and are kept; rows that share an id are compared by their texts,
    and kept or not alike where these are equal. No rows: no rows.
    """
    signed = written(signatures(docs, text, doc_id, bands, rows), "signatures")
    real = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = [F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("holders")]
    classes = written(real.groupBy("node", "n_shingles").agg(*first), "classes")
    keyed = classes.select("node", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    together = written(keyed.join(shared, "key"), "buckets")
    mates = together.groupBy("node").agg(F.sum("many").alias("mates"))
    members = written(together.join(mates, "node").select("key", "band", "node", "n", "mates"), "members")
    wanted = mates.select("node").join(classes.select("node", "first_id"), "node")
    texts = docs.select(F.col(doc_id).alias("first_id"), F.col(text).alias("text"), text_hash(text).alias("same"))
    sets = written(_sets(texts.join(wanted, "first_id").dropDuplicates(["first_id", "node", "same"])), "sets")

    links = met = roots = None
    for number in itertools.count():
        open_ = _open(members, roots)
        star = _star(open_, number, percent)
        star = written(star if met is None else star.join(met, ["a", "b"], "left_anti"), "pairs")
        found = written(_confirmed(star, sets, percent), "links")
        links, met = (found, star) if met is None else (links.unionByName(found), met.unionByName(star))
        linked, pairs = found.count(), star.count()
        if linked:
            roots = connected(links)
        if linked * WORTHWHILE < pairs or not pairs:
            break
    open_ = _open(members, roots) if linked else open_
    rest = written(_rest(open_, classes, sets, percent).join(met, ["a", "b"], "left_anti"), "pairs")
    more = written(_confirmed(rest, sets, percent), "links")
    if not more.isEmpty():
        roots = connected(links.unionByName(more))

    held = classes.select("node", "first_id", "holders")
    if roots is not None:
        named = held.join(roots, "node")
        least = named.groupBy("root").agg(F.min("first_id").alias("least"))
        held = held.join(named.join(least, "root").select("node", "least"), "node", "left")
    else:
        held = held.withColumn("least", F.col("first_id"))
    held = written(held.filter("holders > 1 OR least IS NOT NULL").withColumn("least", F.coalesce("least", "first_id")), "held")
    for done in (together, members, sets):
        discard(done)
    return _named(signed, held)


def _named(signed: DataFrame, held: DataFrame) -> DataFrame:
    """Every document with the least id of its component.

    A set that very many documents hold would bring them all to one task: fewer than HEAVY
    sets can be held by more than one in HEAVY documents, so these are broadcast.
    """
    usual = held.agg(F.sum("holders").alias("n")).first()["n"] or 0
    heavy = held.filter(F.col("holders") * HEAVY > usual).select("node", F.col("least").alias("heavy_least"))
    rows = signed.select("doc_id", "text_hash", "n_shingles", "node").join(F.broadcast(heavy), "node", "left")
    elsewhere = F.when(F.col("heavy_least").isNull(), F.col("node")).otherwise(F.xxhash64("doc_id", "node"))
    rows = rows.withColumn("key", elsewhere).drop("node")
    rows = rows.join(held.select(F.col("node").alias("key"), "least"), "key", "left")
    least = F.coalesce("heavy_least", "least", "doc_id")
    component = F.when(F.col("n_shingles") > 0, least).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.col("doc_id").eqNullSafe(F.when(F.col("doc_id").isNotNull(), component)).alias("kept"),
        "text_hash",
    )


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``duplicate_groups`` without text_hash, for tables whose ids tell rows apart."""
    return duplicate_groups(docs, text, doc_id, percent, bands, rows).drop("text_hash")
