"""Scores of texts under a bigram model with Katz backoff and Good-Turing discounts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.durable import discard, written
from tideline.llm.sampling import fold

FOLDS, HELD_OUT = 10, 0
CUT = 5  # counts up to this are discounted by Good-Turing
ABOVE = 0.1  # taken from every larger count, so that each history can back off
MOST_FREQUENT = 4_096
HOT_LEAST = 10_000  # occurrences from which a bigram may be spread over all buckets
BUCKET_BYTES = 16 << 20  # of text per bucket of the model
FLUSH = 3_000_000  # tokens that a task gathers before it deals them out
END, START = np.uint64(1), np.uint64(2)  # in place of a word's fingerprint
TALLIES = 2 * CUT + 4

_SORTED = {"w", "h", "ref"}
_SCHEMA = "kind int, bucket int, key long, vals array<long>, payload binary"
STATS, TEXTS, FREQUENT, EVENTS = range(4)
SUMS = ("n1", "n2", "n3", "n4", "n5", "known", "s", "base")


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes; ascending ones as differences."""
    parts = []
    for name, a in arrays.items():
        if name in _SORTED and len(a):
            a = np.concatenate([a[:1], a[1:] - a[:-1]])
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        parts.append((name, a.dtype.str, len(a), planes))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts))


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, kind, n, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(payload)):
        size = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).reshape(n)
        out[name] = np.cumsum(a, dtype=a.dtype) if name in _SORTED and n else a
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the narrowest type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Katz's factors for the counts 1 to CUT from the numbers of types with count 1 to CUT + 1.

    Where these give no factor in (0, 1), as in small or odd data, count r keeps (r - 0.5) / r.
    """
    r = np.arange(1, CUT + 1)
    n = np.asarray(counts, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = (CUT + 1) * n[CUT] / n[0]
        d = ((r + 1) * n[1:] / n[:-1] / r - rest) / (1 - rest)
    return np.where(np.isfinite(d) & (d > 0) & (d < 1), d, (r - 0.5) / r)


@dataclass
class Unigrams:
    """Discounted probabilities of words by their count; count 0 is any word never seen."""

    total: int
    factors: np.ndarray
    unseen: float

    def logs(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.zeros(len(counts))
        c = counts.astype(float)
        kept = np.where(c > CUT, c - ABOVE, c * np.append(1.0, self.factors)[np.minimum(counts, CUT).astype(int)])
        return np.log10(np.where(counts > 0, kept / self.total, self.unseen))


def backoff(tallies: np.ndarray, factors: np.ndarray, words: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """(count, backoff weight) per history from its tallies: followers by their count with it (1 to
    CUT, more), the sum of the larger counts, and the same of the followers' own counts.

    The weight is the mass that discounts left, over the probability of all words that do
    not follow: probabilities after each history sum to one.
    """
    t, r = tallies.astype(float), np.arange(1, CUT + 1)
    count = t[:, :CUT] @ r + t[:, CUT + 1]
    left = (t[:, :CUT] @ (r * (1 - factors)) + ABOVE * t[:, CUT]) / np.maximum(count, 1)
    own = t[:, CUT + 2 :]
    covered = (own[:, :CUT] @ (r * words.factors) + own[:, CUT + 1] - ABOVE * own[:, CUT]) / max(words.total, 1)
    return count, left / (1 - covered)


@dataclass(frozen=True)
class Hot:
    """Bigrams that no single bucket may hold, ascending by ``keys``, with their training counts."""

    keys: np.ndarray
    h: np.ndarray
    w: np.ndarray
    counts: np.ndarray


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    from tideline.llm.words import mix

    return (mix(x) % np.uint64(buckets)).astype(np.int64)


def is_in(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)
    return ascending[at] == x


def bigrams(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history, word, text) of all tokens; every text begins after START and closes with END."""
    n = len(words.bounds) - 1
    w = np.insert(words.hashes, words.bounds[1:], END)
    text = np.repeat(np.arange(n), np.diff(words.bounds) + 1)
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.concatenate([[0], np.cumsum(np.diff(words.bounds) + 1)[:-1]])] = START
    return h, w, text


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One fingerprint for a history and a word."""
    from tideline.llm.words import mix

    return mix(mix(w) + h * np.uint64(0xC2B2AE3D27D4EB4F))


def hot_counts(h: np.ndarray, w: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Which bigrams are hot, and the training count of those."""
    if not len(hot.keys):
        return np.zeros(len(w), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(hot.keys, key := pair_key(h, w)), len(hot.keys) - 1)
    found = (hot.keys[at] == key) & (hot.h[at] == h) & (hot.w[at] == w)
    return found, hot.counts[at[found]]


def deal(held: np.ndarray, refs: np.ndarray, ids: np.ndarray, h, w, text, frequent, hot: Hot, buckets: int) -> Iterator[tuple]:
    """(bucket, payload) of a run of texts: tokens go to the bucket of their word, those of a
    frequent word to that of the bigram, those of a hot bigram to that of bigram and text;
    a text's own facts go to the bucket of its number."""
    from tideline.llm.words import mix

    key = np.where(is_in(w, frequent), mix(w) + h, w)
    spread, _ = hot_counts(h, w, hot)
    key[spread] = mix(key[spread]) + refs[text[spread]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = bucket_of(key, buckets)
    order = np.argsort(small(at), kind="stable")
    ends = np.searchsorted(at[order], np.arange(buckets + 1))
    own = (refs % buckets).astype(np.int64)
    sizes = np.bincount(text, minlength=len(refs))
    for bucket in range(buckets):
        rows, mine = order[ends[bucket] : ends[bucket + 1]], np.flatnonzero(own == bucket)
        if not len(rows) and not len(mine):
            continue
        words, word = np.unique(w[rows], return_inverse=True)
        by_word = np.argsort(word, kind="stable")
        rows = rows[by_word]
        histories, history = np.unique(h[rows], return_inverse=True)
        texts, of = np.unique(text[rows], return_inverse=True)
        yield bucket, pack(
            w=words, wn=small(np.bincount(word, minlength=len(words))), h=histories, hi=small(history),
            ref=refs[texts], held=held[texts], ri=small(of),
            info=refs[mine], info_id=ids[mine], info_held=held[mine], info_n=small(sizes[mine]),
        )


def by_bucket(rows: pa.RecordBatch | dict, size: int) -> pa.RecordBatch:
    """A batch of _SCHEMA with the given columns; the others are null."""
    columns = []
    for name, kind in (x.split() for x in _SCHEMA.split(", ")):
        if name in rows:
            columns.append(rows[name])
        else:
            columns.append(pa.nulls(size, _TYPES[kind]))
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCHEMA.split(", ")])


_TYPES = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


def one_payload(kind: int, bucket: int, payload: bytes) -> pa.RecordBatch:
    columns = {"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "payload": pa.array([payload], pa.binary())}
    return by_bucket(columns, 1)


def by_text(texts: np.ndarray, buckets: int, **sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of texts, packed for the bucket that gathers each text."""
    home = texts % buckets
    order = np.argsort(home, kind="stable")
    ends = np.searchsorted(home[order], np.arange(buckets + 1))
    for bucket in np.unique(home).tolist():
        part = order[ends[bucket] : ends[bucket + 1]]
        yield one_payload(TEXTS, bucket, pack(ref=texts[part], **{k: v[part] for k, v in sums.items()}))


def unpacked(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, list[dict]]]:
    """The payloads of (bucket, payload) rows, by bucket."""
    found: dict[int, list[dict]] = {}
    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            found.setdefault(bucket, []).append(unpack(payload.as_py()))
    return list(found.items())


def binned(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1 to CUT + 1."""
    return np.bincount(np.minimum(counts, CUT + 1 + (counts > CUT + 1)), minlength=CUT + 3)[1 : CUT + 2]


def followers(h: np.ndarray, of_pair: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories and their tallies from bigrams, each given once with its count and its word's."""
    histories, history = np.unique(h, return_inverse=True)
    table = np.zeros((len(histories), TALLIES), np.int64)
    for at, c in ((0, of_pair), (CUT + 2, of_word)):
        np.add.at(table, (history, at + np.minimum(c, CUT + 1) - 1), 1)
        table[:, at + CUT + 1] = np.bincount(history, np.where(c > CUT, c, 0), minlength=len(histories))
    return histories, table


def count_bucket(
    payloads: list[dict], frequent: np.ndarray, frequent_counts: np.ndarray, hot: Hot, buckets: int
) -> Iterator[pa.RecordBatch]:
    """What one bucket of the model knows, as rows of _SCHEMA: counts of counts; per text the counts
    of its tokens; per history its followers; and held-out bigrams that training has not.

    A hot bigram is in many buckets: its count is given, and the driver adds it to the tables.
    """
    join = lambda name: np.concatenate([p[name] for p in payloads])
    facts = {x: join(x) for x in ("info", "info_id", "info_held", "info_n")}
    if len(facts["info"]):
        yield one_payload(TEXTS, int(facts["info"][0] % buckets), pack(**facts))
    w = np.concatenate([np.repeat(p["w"], p["wn"]) for p in payloads])
    if not len(w):
        return
    h = np.concatenate([p["h"][p["hi"]] for p in payloads])
    ref = np.concatenate([p["ref"][p["ri"]] for p in payloads])
    train = ~np.concatenate([p["held"][p["ri"]] for p in payloads])

    words, word = np.unique(w, return_inverse=True)
    own = np.bincount(word, train, minlength=len(words)).astype(np.int64)
    often = is_in(words, frequent)
    own[often] = frequent_counts[np.searchsorted(frequent, words[often])]
    of_word = own[word]
    order = np.argsort(pair_key(h, w))
    w, h, ref, train, of_word = w[order], h[order], ref[order], train[order], of_word[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]))
    counts = np.add.reduceat(train.astype(np.int64), first)
    spread, known_counts = hot_counts(h[first], w[first], hot)
    counts[spread] = known_counts
    of_pair = np.repeat(counts, np.diff(np.append(first, len(w))))

    rare = own[~often]
    stats = [*binned(counts[~spread]), *binned(rare), (rare > CUT).sum(), (rare > 0).sum(), train.sum()]
    stats = np.array(stats).astype(np.int64)
    yield by_bucket({"kind": pa.array([STATS], pa.int32()), "vals": pa.array([stats.tolist()], pa.list_(pa.int64()))}, 1)

    texts, text = np.unique(ref, return_inverse=True)
    add = lambda x, where=slice(None): np.bincount(text[where], x, minlength=len(texts))
    s = add(np.where(of_pair > CUT, np.log10(np.maximum(of_pair - ABOVE, ABOVE)), 0.0))
    s -= add(np.where((w != END) & (of_word > 0), np.log10(np.maximum(of_word, 1)), 0.0))
    tallies = {f"n{r}": small(np.bincount(text[of_pair == r], minlength=len(texts))) for r in range(1, CUT + 1)}
    known = small(np.bincount(text, of_word > 0, minlength=len(texts)).astype(np.int64))
    yield from by_text(texts, buckets, **tallies, known=known, s=s, base=add(np.log10(of_word + 0.1)))

    kept = first[(counts > 0) & ~spread]
    histories, table = followers(h[kept], of_pair[kept], of_word[kept])
    often = is_in(histories, frequent)
    yield by_bucket(
        {"kind": pa.array(np.full(often.sum(), FREQUENT, np.int32)), "key": pa.array(histories[often].view(np.int64)),
         "vals": pa.array(table[often].tolist(), pa.list_(pa.int64()))}, int(often.sum())
    )
    histories, table = histories[~often], table[~often]
    new = ~train & (of_pair == 0)
    h, ref, of_word = h[new], ref[new], of_word[new]
    to = bucket_of(np.where(is_in(h, frequent), h + ref.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), h), buckets)
    home = bucket_of(histories, buckets)
    for bucket in np.union1d(to, home).tolist():
        a, b = home == bucket, np.flatnonzero(to == bucket)
        b = b[np.argsort(h[b], kind="stable")]
        payload = pack(
            h=histories[a], **{f"t{i}": small(table[a, i]) for i in range(TALLIES)},
            eh=h[b], ref_=ref[b], c=small(of_word[b]),
        )
        yield one_payload(EVENTS, bucket, payload)


def back_off(payloads: list[dict], frequent_weights: tuple, factors: np.ndarray, words: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """(text, log10 probability correction) of the unseen bigrams of one bucket of histories."""
    join = lambda name: np.concatenate([p[name] for p in payloads])
    every = join("h")
    histories, at = np.unique(every, return_inverse=True)
    tallies = np.stack([np.bincount(at, join(f"t{i}"), minlength=len(histories)) for i in range(TALLIES)], 1)
    count, weight = backoff(tallies, factors, words)
    histories = np.concatenate([histories, frequent_weights[0]])
    count, weight = np.concatenate([count, frequent_weights[1]]), np.concatenate([weight, frequent_weights[2]])
    order = np.argsort(histories)
    histories, count, weight = histories[order], count[order], weight[order]
    h, ref, c = join("eh"), join("ref_"), join("c")
    score = words.logs(c)
    if len(histories) and len(h):
        k = np.minimum(np.searchsorted(histories, h), len(histories) - 1)
        known = (histories[k] == h) & (count[k] > 0)
        # the text's own tally already divides by the history's count, which backing off does not
        score[known] += np.log10(weight[k[known]]) + np.log10(count[k[known]])
    return ref, score


def katz_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row.

    The model learns from rows whose crc32 of the id is not divisible by FOLDS. A bigram seen c
    times after a history seen n times has probability d(c) * c / n, with Good-Turing's d up to
    CUT and c - ABOVE beyond; others have the history's backoff weight times the unigram
    probability, discounted alike, whose rest goes to one symbol for all unknown words. After
    an unknown history the unigram stands alone.

    Tokens are dealt out once, by word: a bucket holds all training and held-out occurrences of
    its words, so counts, counts of counts and the sums of every text come from one
    shuffle, and the tables of the model (counts per text, followers per history) are
    stored by kind. Only held-out bigrams that training lacks go on, to the bucket of their
    history. Frequent words are spread over all buckets by bigram, and hot bigrams by text;
    the counts and weights of these bounded lists, taken from all texts, are the only broadcast.

    A null text is an empty one: a single end. Ids are integers; a null id is in the training
    part. Repeated rows count and are scored each. Without training rows both scores are 0.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), (fold(doc_id, FOLDS) == HELD_OUT).alias("held")
    )
    facts = base.agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.sum((~F.col("held")).cast("long")).alias("train")
    ).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(facts["bytes"] or 0) // BUCKET_BYTES))
    frequent, frequent_counts, hot = _frequent(base, buckets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tideline.llm.words import slices

        gathered, size, docs_so_far = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, w, of, refs, ids, held = (np.concatenate(x) for x in zip(*gathered))
            for bucket, payload in deal(held, refs, ids, h, w, of, frequent, hot, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], ["bucket", "payload"])

        for batch in batches:
            # a null id is carried as the smallest number
            ids = batch.column(1).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            held = batch.column(2).to_numpy(zero_copy_only=False)
            refs = batch.column(3).to_numpy()
            for words in slices(batch.column(0)):
                h, w, of = bigrams(words)
                n = len(words.bounds) - 1
                part = slice(words.first, words.first + n)
                gathered.append((h, w, of + docs_so_far, refs[part], ids[part], held[part]))
                size, docs_so_far = size + len(w), docs_so_far + n
                if size >= FLUSH:
                    yield from flush()
                    gathered.clear()
                    size = docs_so_far = 0
        if gathered:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in unpacked(batches):
            yield from count_bucket(payloads, frequent, frequent_counts, hot, buckets)

    numbered = base.withColumn("ref", F.monotonically_increasing_id())
    dealt = numbered.mapInArrow(emit, "bucket int, payload binary").repartitionById(buckets, F.col("bucket"))
    model = written(dealt.mapInArrow(count, _SCHEMA), "katz", "kind")

    stats = np.zeros(2 * CUT + 5)
    sums = model.filter(f"kind = {STATS}").select(F.posexplode("vals").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    for row in sums.collect():
        stats[row["i"]] = row["v"]
    pairs, single = stats[: CUT + 1] + binned(hot.counts), stats[CUT + 1 : 2 * CUT + 2].copy()
    big, vocabulary, total = int(stats[-3]), int(stats[-2]), int(stats[-1])
    for c in frequent_counts[frequent != START]:
        if c:
            vocabulary += 1
            big += c > CUT
            if c <= CUT + 1:
                single[c - 1] += 1
    factors, own = discounts(pairs), discounts(single)
    left = (single[:CUT] @ (np.arange(1, CUT + 1) * (1 - own)) + ABOVE * big) / max(total, 1)
    unigrams = Unigrams(total, own, left or 1.0)
    tallied = model.filter(f"kind = {FREQUENT}").groupBy("key").agg(
        *(F.sum(F.element_at("vals", i + 1)).alias(f"t{i}") for i in range(TALLIES))
    ).collect()
    seen = hot.counts > 0
    more, table = followers(hot.h[seen], hot.counts[seen], frequent_counts[np.searchsorted(frequent, hot.w[seen])])
    every = np.concatenate([np.array([r["key"] for r in tallied], np.int64).view(np.uint64), more])
    heads, at = np.unique(every, return_inverse=True)
    tallies = np.zeros((len(heads), TALLIES))
    np.add.at(tallies, at, np.concatenate([np.array([r[1:] for r in tallied], float).reshape(-1, TALLIES), table]))
    heads = (heads, *backoff(tallies, factors, unigrams))

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in unpacked(batches):
            ref, score = back_off(payloads, heads, factors, unigrams)
            texts, text_ = np.unique(ref, return_inverse=True)
            for row in by_text(texts, buckets, s=np.bincount(text_, score, minlength=len(texts))):
                yield row.select(["bucket", "payload"])

    logs = np.log10(factors * np.arange(1, CUT + 1))
    starts = float(np.log10(max(facts["train"] or 0, 1)))
    below = float(np.log10(total + 0.1 * (vocabulary + 1)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in unpacked(batches):
            info = [p for p in payloads if "info" in p]
            refs, ids, held, n = (np.concatenate([p[x] for p in info]) for x in ("info", "info_id", "info_held", "info_n"))
            order = np.argsort(refs)
            sums = {x: np.zeros(len(refs)) for x in SUMS}
            for p in payloads:
                at = order[np.searchsorted(refs[order], p["ref"])] if "ref" in p else None
                for x in SUMS:
                    if x in p:
                        sums[x][at] += p[x]
            n = n.astype(np.int64)
            score = sums["s"] - starts + sum(sums[f"n{r + 1}"] * logs[r] for r in range(CUT))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == np.iinfo(np.int64).min), pa.array(held), pa.array(n),
                 pa.array(sums["known"].astype(np.int64)), pa.array(np.full(len(n), total)),
                 pa.array(sums["base"] - n * below), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    events = model.filter(f"kind = {EVENTS}").select("bucket", "payload").repartitionById(buckets, F.col("bucket"))
    more = events.mapInArrow(unseen, "bucket int, payload binary")
    texts = model.filter(f"kind = {TEXTS}").select("bucket", "payload").unionByName(more)
    return texts.repartitionById(buckets, F.col("bucket")).mapInArrow(
        finish,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _frequent(base: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, Hot]:
    """Frequent words, with START and END, hot bigrams, and how often each is in the whole
    training part (START: as a history).

    A run of tokens in a task names what makes up half of 1 / share of it, so the sums of
    what was named miss less than that of anything: whatever is more than one in ``share``
    tokens of all texts is found, wherever it is, and at most 2 * share bigrams are.
    """
    share = max(MOST_FREQUENT, buckets)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tideline.llm.words import slices

        for batch in batches:
            for words in slices(batch.column(0)):
                h, w, _ = bigrams(words)
                size = len(w)
                _, first, times = np.unique(pair_key(h, w), return_index=True, return_counts=True)
                many = times * 2 * share >= size
                found, often = np.unique(w, return_counts=True)
                top = often * 2 * share >= size
                h, w, n = h[first[many]], w[first[many]], times[many]
                h, w, n = np.append(h, np.zeros(top.sum(), np.uint64)), np.append(w, found[top]), np.append(n, often[top])
                single = np.arange(len(h)) >= many.sum()
                columns = [pa.array(single), pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["single", "h", "w", "n"])
                size = pa.array([size], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.bool_()), *(pa.array([0], pa.int64()),) * 2, size], ["single", "h", "w", "n"])

    named = base.select("text").mapInArrow(name, "single boolean, h long, w long, n long").groupBy("single", "h", "w")
    named = written(named.agg(F.sum("n").alias("n")), "katz-named")
    every = named.filter("single IS NULL").agg(F.sum("n").alias("all")).first()["all"] or 0
    top = named.filter(f"single IS NOT NULL AND n * 2 * {share} >= {every} AND (single OR n >= {HOT_LEAST})").collect()
    discard(named)
    as_keys = lambda x: np.array(x, np.int64).view(np.uint64)
    hot_h, hot_w = (as_keys([r[x] for r in top if not r["single"]]) for x in ("h", "w"))
    own = as_keys([r["w"] for r in top if r["single"]])
    frequent = np.unique(np.concatenate([np.array([END, START], np.uint64), own, hot_h, hot_w]))
    order = np.argsort(keys := pair_key(hot_h, hot_w))
    hot = Hot(keys[order], hot_h[order], hot_w[order], np.arange(len(order)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tideline.llm.words import slices

        totals, pairs = np.zeros(len(frequent), np.int64), np.zeros(len(hot.keys), np.int64)
        for batch in batches:
            totals[np.searchsorted(frequent, np.array([START, END]))] += batch.num_rows
            for words in slices(batch.column(0)):
                at = np.minimum(np.searchsorted(frequent, words.hashes), len(frequent) - 1)
                totals += np.bincount(at[frequent[at] == words.hashes], minlength=len(frequent))
                if len(pairs):
                    h, w, _ = bigrams(words)
                    pairs += np.bincount(hot_counts(h, w, hot)[1], minlength=len(pairs))
        totals = np.concatenate([totals, pairs])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals))), pa.array(totals)], ["i", "n"])

    counts = np.zeros(len(frequent) + len(hot.keys), np.int64)
    learned = base.filter("NOT held").select("text").mapInArrow(tally, "i long, n long")
    for row in learned.groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[row["i"]] = row["n"]
    return frequent, counts[: len(frequent)], Hot(hot.keys, hot.h, hot.w, counts[len(frequent) :])
