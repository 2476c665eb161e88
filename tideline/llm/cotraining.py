"""Document quality by co-training two views: what a text is like, and what its metadata say."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.durable import written
from tideline.llm.sampling import sampled

MOST_LABELLED = 12_000  # labelled rows that the first models are fitted on
ROUNDS = 3
STEPS = 3  # Newton steps of a round, each a pass over the features of all unlabelled rows
CONFIDENT = 0.95
LEAST_WEIGHT = 1_000.0  # of all pseudo-labels of a view together, or that of the labelled rows if more
BINS = 12
METADATA_BUCKETS = 256
ACCEPT = 0.5

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[ord("0") : ord("9") + 1] = 1
_CLASSES[65:91] = 2
_CLASSES[97:123] = 3
_CLASSES[128:] = 4
for _c in b".,;:'\"()-?":
    _CLASSES[_c] = 5
for _c in b"#$%&*@^~<>{}[]\\/|_=+`":
    _CLASSES[_c] = 6
_CLASSES[ord("!")] = 7
_CLASSES[10] = 8
KINDS = 9
MEASURES = KINDS + 9


def measures(words) -> np.ndarray:
    """Per text of the slice: shares of byte classes, and how words and lines repeat."""
    n = len(words.bounds) - 1
    kinds = _CLASSES[words.buffer]
    text = np.repeat(np.arange(n), np.diff(words.offsets))
    counts = np.bincount(text * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS).astype(float)
    size = np.maximum(counts.sum(1), 1)
    out = np.zeros((n, MEASURES))
    out[:, :KINDS] = counts / size[:, None]
    letters = np.maximum(counts[:, 2] + counts[:, 3] + counts[:, 4], 1)
    out[:, 2] = counts[:, 2] / letters
    n_words = np.maximum(np.diff(words.bounds), 1)
    lengths = words.ends - words.starts
    owner = np.repeat(np.arange(n), np.diff(words.bounds))
    per_text = lambda x: np.bincount(owner, x, minlength=n)
    last = kinds[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    same = np.zeros(len(owner))
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    mean = per_text(lengths) / n_words
    out[:, KINDS] = np.log1p(n_words)
    out[:, KINDS + 1] = mean
    out[:, KINDS + 2] = np.sqrt(np.maximum(per_text(lengths.astype(float) ** 2) / n_words - mean**2, 0))
    out[:, KINDS + 3] = per_text(same) / n_words
    out[:, KINDS + 4] = per_text(last >= 6) / n_words
    out[:, KINDS + 5] = per_text(lengths == 1) / n_words
    for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
        if b > a:
            _, times = np.unique(words.hashes[a:b], return_counts=True)
            out[i, KINDS + 6] = len(times) / (b - a)
            out[i, KINDS + 7] = times.max() / (b - a)
    out[:, KINDS + 8] = counts[:, 8] / n_words
    return out


def metadata_buckets(source, lang, n_chars) -> list[int]:
    """Source and language as hashed values, length as its power of two; null is a value of its own."""
    size = "" if n_chars is None else str(max(int(n_chars), 0).bit_length())
    fields = (("source", source), ("lang", lang), ("size", size), ("both", f"{source}\x00{lang}"))
    return [xxhash.xxh32_intdigest(f"{k}={v}") % METADATA_BUCKETS for k, v in fields]


@dataclass
class View:
    """A logistic model over one-hot features, with a calibration of its logits."""

    width: int
    weights: np.ndarray = field(init=False)
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.weights = np.zeros(self.width + 1)

    def moments(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The logistic loss's second derivatives, and its gradient as one more row."""
        total = np.zeros((self.width + 2, self.width + 1))
        for a in range(0, len(x), 4096):
            dense, w = self._dense(x[a : a + 4096]), weight[a : a + 4096]
            p = _logistic(dense @ self.weights)
            total[:-1] += (dense * (w * p * (1 - p))[:, None]).T @ dense
            total[-1] += dense.T @ (w * (p - y[a : a + 4096]))
        return total

    def step(self, moments: np.ndarray) -> None:
        """A Newton step on the loss with a ridge."""
        ridge = np.full(self.width + 1, 1.0)
        ridge[-1] = 1e-3
        self.weights = self.weights - np.linalg.solve(moments[:-1] + np.diag(ridge), moments[-1] + ridge * self.weights)

    def _dense(self, x: np.ndarray) -> np.ndarray:
        dense = np.zeros((len(x), self.width + 1))
        np.put_along_axis(dense, x, 1.0, axis=1)
        dense[:, -1] = 1
        return dense

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[x].sum(1) + self.weights[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on examples no training set of the view has."""
        f = self.logit(x)
        up, down = y.sum(), len(y) - y.sum()
        target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - target) * f).sum() + 1e-3 * (a - 1), (p - target).sum()])
            h = np.array([[(v * f * f).sum() + 1e-3, (v * f).sum()], [(v * f).sum(), v.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.slope, self.shift = float(a), float(b)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.logit(x) + self.shift


@dataclass
class QualityModel:
    borders: np.ndarray
    content: View
    metadata: View
    prior: float  # logit

    def scores(self, values: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated logits of both views, and their sum less the prior both contain."""
        a, b = self.content.calibrated(content_features(self.borders, values)), self.metadata.calibrated(buckets)
        return a, b, a + b - self.prior


def handed(givers: tuple[View, View], features: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """What each view hands to the other: 1 or 0 for rows it is CONFIDENT of, else -1."""
    out = []
    for view, x in zip(givers, features):
        p = _logistic(view.calibrated(x))
        out.append(np.where(p >= CONFIDENT, 1, np.where(1 - p >= CONFIDENT, 0, -1)))
    return out


def handed_counts(givers: tuple[View, View], features: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per view how many rows it hands over as 0 and as 1."""
    return np.array([[(given == label).sum() for label in (0, 1)] for given in handed(givers, features)])


def handed_moments(
    givers: tuple[View, View], takers: tuple[View, View], weights: np.ndarray, features: tuple[np.ndarray, np.ndarray]
) -> list[np.ndarray]:
    """Per view the moments of the rows that the other hands to it, each label with its weight."""
    given = handed(givers, features)
    out = []
    for number, (view, x) in enumerate(zip(takers, features)):
        labels = given[1 - number]
        rows = labels >= 0
        out.append(view.moments(x[rows], labels[rows], weights[1 - number][labels[rows]]))
    return out


class Local:
    """Unlabelled rows at hand, as features of both views."""

    def __init__(self, content: np.ndarray, metadata: np.ndarray):
        self.features = content, metadata

    def counts(self, givers) -> np.ndarray:
        return handed_counts(givers, self.features)

    def moments(self, givers, takers, weights) -> list[np.ndarray]:
        return handed_moments(givers, takers, weights, self.features)


class Stored:
    """Unlabelled rows of any number, in a table of (features binary): a byte per measure and per metadata field.

    Tasks add up what their rows hand over; the driver sees sums whose size the widths of the views fix.
    """

    def __init__(self, table: DataFrame):
        self.table = table

    def _summed(self, work) -> dict[tuple[int, int, int], float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: list[np.ndarray] | None = None
            for batch in batches:
                rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, MEASURES + 4).astype(np.int64)
                found = work((rows[:, :MEASURES] + np.arange(MEASURES) * BINS, rows[:, MEASURES:]))
                totals = found if totals is None else [t + f for t, f in zip(totals, found)]
            for view, total in enumerate(totals or []):
                i, j = np.nonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), view, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].astype(float))],
                    ["view", "i", "j", "value"],
                )

        sums = self.table.select("features").mapInArrow(run, "view int, i int, j int, value double")
        return {(r["view"], r["i"], r["j"]): r["s"] for r in sums.groupBy("view", "i", "j").agg(F.sum("value").alias("s")).collect()}

    def counts(self, givers) -> np.ndarray:
        out = np.zeros((2, 2))
        for (view, _, label), n in self._summed(lambda x: [c[None, :] for c in handed_counts(givers, x)]).items():
            out[view, label] = n
        return out

    def moments(self, givers, takers, weights) -> list[np.ndarray]:
        out = [np.zeros((v.width + 2, v.width + 1)) for v in takers]
        for (view, i, j), value in self._summed(lambda x: handed_moments(givers, takers, weights, x)).items():
            out[view][i, j] = value
        return out


def bin_borders(values: np.ndarray) -> np.ndarray:
    grid = np.linspace(0, 1, BINS + 1)[1:-1]
    return np.stack([np.quantile(v, grid) for v in values.T]) if len(values) else np.zeros((MEASURES, BINS - 1))


def content_features(borders: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One feature per measure: the bin it falls in."""
    bins = np.stack([np.searchsorted(b, v, "right") for b, v in zip(borders, values.T)], 1)
    return bins + np.arange(MEASURES) * BINS


def cotrain(values, buckets, labels, pool=None) -> QualityModel:
    """``labels`` is 1, 0, or -1 for rows without one; more rows without one come in ``pool``.

    A fifth of the labelled rows calibrates and trains nothing. Both views are fitted on the
    rest and calibrated. In each round each view hands the other its label of every unlabelled row
    that it is CONFIDENT of, and takes STEPS Newton steps on the labelled rows and what it was
    handed. The labels handed over weigh as much as the labelled rows together (LEAST_WEIGHT if
    these are fewer, one each if the pool is small), divided among the classes in their proportion.
    """
    known = np.flatnonzero(labels >= 0)
    borders = bin_borders(values)
    views = View(MEASURES * BINS), View(METADATA_BUCKETS)
    share = (labels[known].sum() + 1) / (len(known) + 2)
    model = QualityModel(borders, *views, float(np.log(share / (1 - share))))
    inputs = (content_features(borders, values) if len(values) else np.zeros((0, MEASURES), int), buckets)
    spare = np.arange(len(known)) % 5 == 0
    calibration, training = known[spare], known[~spare]
    free = np.flatnonzero(labels < 0)
    if pool is None:
        pool = Local(*(x[free] for x in inputs)) if len(free) else None

    def step(more) -> None:
        for view, x, extra in zip(views, inputs, more):
            view.step(view.moments(x[training], labels[training], np.ones(len(training))) + extra)

    def calibrate() -> None:
        if len(calibration) and len(training):
            for view, x in zip(views, inputs):
                view.calibrate(x[calibration], labels[calibration])

    for _ in range(8):
        step((0, 0))
    calibrate()
    for _ in range(ROUNDS if pool is not None and len(training) else 0):
        givers = tuple(replace(v) for v in views)
        for giver, view in zip(givers, views):
            giver.weights = view.weights
        counts = pool.counts(givers)
        whole = np.minimum(counts.sum(1), max(float(len(training)), LEAST_WEIGHT))
        weights = whole[:, None] * np.array([1 - share, share])[None, :] / np.maximum(counts, 1)
        weights = np.minimum(weights, 1.0)
        for _ in range(STEPS):
            step(pool.moments(givers, views, weights))
        calibrate()
    return model


def _examples(docs: DataFrame) -> DataFrame:
    """(label, measures, buckets) of rows (label, text, source, lang, n_chars)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tideline.llm.words import slices

        for batch in batches:
            meta = [metadata_buckets(*m) for m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            for words in slices(batch.column(1)):
                found = measures(words)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, n),
                        pa.array(found.tolist(), pa.list_(pa.float64())),
                        pa.array(meta[words.first : words.first + n], pa.list_(pa.int32())),
                    ],
                    ["label", "measures", "buckets"],
                )

    return docs.mapInArrow(extract, "label int, measures array<double>, buckets array<int>")


def _views(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """id, text and metadata; a metadata column the table lacks is null."""
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    own = {c: F.col(c) if c in docs.columns else F.lit(None) for c in kinds}
    meta = (own[c].cast(k).alias(c) for c, k in kinds.items())
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *meta, *more)


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    most_labelled: int = MOST_LABELLED,
) -> QualityModel:
    """A model fitted on a bounded sample of ``most_labelled`` labelled rows, and on all documents
    without a label, as far as the views are sure of them."""
    base = _views(docs, doc_id, text)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter(
        "label IS NOT NULL AND id IS NOT NULL"
    )
    # a row labelled more than once counts once, with its lowest label
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    picked = sampled(known, "id", most_labelled, known.count(), 1)
    # ids within most_labelled
    labelled = base.join(F.broadcast(picked), "id").select("label", "text", "source", "lang", "n_chars")
    rows = sorted((tuple(r["measures"]), tuple(r["buckets"]), r["label"]) for r in _examples(labelled).toLocalIterator())
    order = np.random.default_rng(1).permutation(len(rows))
    values = np.array([rows[i][0] for i in order]).reshape(-1, MEASURES)
    buckets = np.array([rows[i][1] for i in order], int).reshape(-1, 4)
    marks = np.array([rows[i][2] for i in order], int)
    if not len(rows):
        return cotrain(values, buckets, marks)
    others = _features(base, bin_borders(values)).join(known.select("id"), "id", "left_anti").select("features")
    return cotrain(values, buckets, marks, Stored(written(others, "unlabelled")))


def _features(base: DataFrame, borders: np.ndarray) -> DataFrame:
    """(id, features): the bins and buckets of every row, as bytes."""
    kind = base.schema["id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tideline.llm.words import slices

        for batch in batches:
            meta = [metadata_buckets(*m) for m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            for words in slices(batch.column(1)):
                n = len(words.bounds) - 1
                bins = content_features(borders, measures(words)) - np.arange(MEASURES) * BINS
                both = np.concatenate([bins, np.array(meta[words.first : words.first + n], int).reshape(-1, 4)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, n), pa.array([r.tobytes() for r in both], pa.binary())], ["id", "features"]
                )

    return base.select("id", "text", "source", "lang", "n_chars").mapInArrow(extract, f"id {kind}, features binary")


def _judged(model: QualityModel, texts: pa.Array, metadata: list[pa.Array]) -> Iterator[tuple[int, int, tuple]]:
    """(first row, rows, calibrated logits) per run of texts."""
    from tideline.llm.words import slices

    meta = [metadata_buckets(*m) for m in zip(*(c.to_pylist() for c in metadata))]
    for words in slices(texts):
        n = len(words.bounds) - 1
        buckets = np.array(meta[words.first : words.first + n], int).reshape(-1, 4)
        yield words.first, n, model.scores(measures(words), buckets)


def _logistic(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def classify(docs: DataFrame, model: QualityModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, content_score, metadata_score, score (probabilities of label 1) and accepted
    (score >= ACCEPT) of every whole text.

    A null text is an empty one; null or absent metadata are values like any other; repeated
    rows are judged alike. A model that saw no label scores one half everywhere.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, logits in _judged(shared.value, batch.column(1), batch.columns[2:5]):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), *(pa.array(_logistic(f)) for f in logits)],
                    ["doc_id", "content_score", "metadata_score", "score"],
                )

    found = _views(docs, doc_id, text).mapInArrow(
        apply, f"doc_id {kind}, content_score double, metadata_score double, score double"
    )
    return found.withColumn("accepted", F.col("score") >= ACCEPT)


def accepted(docs: DataFrame, model: QualityModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The accepted rows of ``docs`` with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, logits in _judged(shared.value, batch.column(1), batch.columns[2:5]):
                good = pa.array(_logistic(logits[2]) >= ACCEPT)
                yield pa.RecordBatch.from_arrays([batch.column(5).slice(first, n).filter(good)], ["row"])

    picked = _views(docs, doc_id, text, F.struct("*").alias("row"))
    return picked.mapInArrow(apply, picked.select("row").schema).select("row.*")
