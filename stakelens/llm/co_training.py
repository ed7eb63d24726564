"""Document quality by co-training a text view and a metadata view.

Two logistic classifiers see different features of a document: hashed words of its text, and
its metadata (language, source, length and line layout). They start from at most `LABELLED`
labelled documents; all other rows are the unlabelled side, whose features are stored once.
In each round each view scores all of them, and its most confident pseudo-labels, a share of
the rows that grows by the round, as many of both classes as their share among the labels
says, become training data of the other view. Rows at the edge of that share count in part,
so that ties need no choice. The views then go on from the last round's weights by
gradients that are summed over the partitions, in which the pseudo-labels of a round weigh
`PSEUDO` of what the labels do for each round so far, however many they are. In the end the
views are calibrated on labelled documents that took no part in training (a sigmoid in the
log-odds of each), the calibrated log-odds are added, and every document is scored with both
models, which have a fixed size.

Defined results: a null or empty text has no words; null metadata is a value of its own. Null
ids are kept, and are unlabelled. Repeated rows get equal scores. Labels without an id or
quality are not used; of several for an id, the highest. An empty table gives no rows. With
labels of one class only, all scores are that class's share. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.llm import textops as T
from stakelens.llm.scratch import stored

TEXT_SIZE = 1 << 12
META_SIZE = 1 << 8
LABELLED = 4000
ROUNDS = 4
GROWTH = 0.05  # share of the unlabelled rows by which a view's pseudo-labels grow in a round
PSEUDO = 0.25
BINS = 1 << 10  # of log-odds from -30 to 30
HELD_OUT = 5  # every fifth labelled document calibrates
EPOCHS = 120
RUN_BYTES = 1 << 20  # texts of a chunk
STEPS = 10  # passes over the pseudo-labels of a round
PENALTY = 1e-4
KEEP = 0.5
SCHEMA = "doc_id long, text_score double, meta_score double, score double, kept boolean"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


class Model(NamedTuple):
    """Weights of both views (the last is the bias), and scale and shift of their log-odds."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float


class Rows(NamedTuple):
    """Sparse rows: feature numbers and values, and where each row begins."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.value * weights[self.index])])
        return sums[self.first[1:]] - sums[self.first[:-1]] + weights[-1]

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.first[:-1][rows] - first[:-1], sizes) + np.arange(first[-1])
        return Rows(self.index[at], self.value[at], first)


def text_rows(data: np.ndarray, offsets: np.ndarray) -> Rows:
    """Hashed words of each text with their shares, square-rooted and of unit length; and how
    the words repeat and are written."""
    words = T.words(data, offsets)
    n, counts = len(offsets) - 1, np.maximum(words.counts, 1)
    owner = T.owners(words.first)
    bucket = (words.hash >> T.U(20)) % T.U(TEXT_SIZE - 64)
    cells = owner * TEXT_SIZE + 64 + bucket.astype(np.int64)
    cell, times = np.unique(cells, return_counts=True)
    value = np.sqrt(times / counts[cell // TEXT_SIZE])
    distinct = np.unique(owner.astype(T.U) * T.U(1 << 40) + (words.hash >> T.U(24)))
    kinds = np.bincount((distinct >> T.U(40)).astype(np.int64), minlength=n)[:n]
    letters = np.zeros(256)
    upper, sign = letters.copy(), letters.copy()
    upper[65:91] = 1
    sign[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
    size = np.maximum(np.diff(offsets), 1)
    shares = [1 - kinds / counts]
    for table in (upper, sign):
        sums = np.concatenate([[0.0], np.cumsum(table[data])])
        shares.append((sums[offsets[1:]] - sums[offsets[:-1]]) / size)
    binned = [np.arange(n) * TEXT_SIZE + 16 * k + np.minimum((s * 16).astype(np.int64), 15)
              for k, s in enumerate(shares)]
    return _rows(np.concatenate([cell, *binned]), np.concatenate([value, *[np.ones(n)] * 3]), n, TEXT_SIZE)


def meta_rows(batch: pa.RecordBatch) -> Rows:
    """One-hot metadata of each row: language, source, length, number and length of lines."""
    cells: list[int] = []
    columns = [batch.column(c).to_pylist() for c in ("lang", "source", "n_chars", "text")]
    for row, (lang, source, n_chars, text) in enumerate(zip(*columns, strict=True)):
        lines = (text or "").count("\n") + 1
        long = -1 if n_chars is None else n_chars
        names = [
            f"lang {lang}",
            f"source {source}",
            f"length {long.bit_length() if long >= 0 else None}",
            f"lines {lines.bit_length()}",
            f"width {(max(long, 0) // lines).bit_length()}",
        ]
        cells += {row * META_SIZE + crc32(name.encode()) % META_SIZE for name in names}
    return _rows(np.array(cells, np.int64), np.ones(len(cells)), len(batch), META_SIZE)


def _rows(cells: np.ndarray, values: np.ndarray, n: int, size: int) -> Rows:
    order = np.argsort(cells, kind="stable")
    cells, values = cells[order], values[order]
    first = np.searchsorted(cells, np.arange(n + 1) * size)
    return Rows(cells % size, values, first)


def _views(batch: pa.RecordBatch) -> Iterator[tuple[slice, Rows, Rows]]:
    for row, data, offsets in T.runs(batch.column("text"), RUN_BYTES):
        some = slice(row, row + len(offsets) - 1)
        yield some, text_rows(data, offsets), meta_rows(batch[some])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Learner:
    """Logistic regression by Adagrad: the weights, and the squares of the slopes so far."""

    def __init__(self, rows: Rows, y: np.ndarray, size: int):
        self.rows, self.y, self.size = rows, y, size
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.parts = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
        self.weights, self.seen = np.zeros(size + 1), np.full(size + 1, 1e-8)

    def step(self, pseudo: np.ndarray | float = 0.0, mass: float = 0.0) -> None:
        """A step along the labelled rows' slope and that of pseudo-labels, `mass` times it."""
        own = _slope(self.rows, self.y, self.parts, self.weights, self.size)
        slope = (own + mass * pseudo) / (1 + mass) + PENALTY * self.weights
        self.seen += slope**2
        self.weights = self.weights - 0.5 * slope / np.sqrt(self.seen)


def _slope(rows: Rows, y: np.ndarray, parts: np.ndarray, weights: np.ndarray, size: int):
    """Sum of the rows' slopes, each times its part."""
    error = (_sigmoid(rows.dot(weights)) - y) * parts
    owner = np.repeat(np.arange(len(rows)), np.diff(rows.first))
    return np.append(np.bincount(rows.index, error[owner] * rows.value, minlength=size), error.sum())


def _scaled(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make the log-odds fit held-out labels, by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = _sigmoid(a * logits + b)
        slope = np.array([((p - y) * logits).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        w = p * (1 - p)
        curve = np.array([[(w * logits**2).sum() + 0.01, (w * logits).sum()],
                          [(w * logits).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(curve, slope)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(max(a, 0.0)), float(b)


def _bin(logits: np.ndarray) -> np.ndarray:
    return np.minimum((np.clip(logits, -30, 30) + 30) * (BINS / 60), BINS - 1).astype(np.int64)


def _parts(counts: np.ndarray, grown: float, share: float) -> np.ndarray:
    """The part of a row in the pseudo-labels by its bin: below 0 for bad ones, above for good.

    The parts of all rows add up to a half for each class, as those of the labelled rows do.
    """
    taken = []
    for each, wanted in ((counts, 1 - share), (counts[::-1], share)):
        before = np.cumsum(each) - each
        taken.append(np.clip(grown * wanted * counts.sum() - before, 0, each))
    bad, good = taken[0], taken[1][::-1]
    sure = (bad == 0) | (good == 0)  # a bin at both ends says nothing
    bad, good = bad * sure, good * sure
    each = np.maximum(counts, 1)
    return (good / max(good.sum(), 1e-9) - bad / max(bad.sum(), 1e-9)) * 0.5 / each


def _summed(table: DataFrame, one: Callable[[dict], np.ndarray], size: int) -> np.ndarray:
    """The sum of a vector over the chunks of a table, one vector a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for k in range(len(batch)):
                total += one(batch.slice(k, 1).to_pylist()[0])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    rows = table.mapInArrow(run, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(size))


def _packed(prefix: str, rows: Rows, **more: np.ndarray) -> dict[str, bytes]:
    held = {"i": rows.index.astype("<u2"), "v": rows.value.astype("<f4"), "f": rows.first.astype("<i4")}
    held |= {name: x.astype("<f8") for name, x in more.items()}
    return {prefix + name: x.tobytes() for name, x in held.items()}


def _unpacked(prefix: str, chunk: dict) -> Rows:
    index = np.frombuffer(chunk[prefix + "i"], "<u2").astype(np.int64)
    value = np.frombuffer(chunk[prefix + "v"], "<f4").astype(np.float64)
    return Rows(index, value, np.frombuffer(chunk[prefix + "f"], "<i4").astype(np.int64))


def _unlabelled(docs: DataFrame, labelled: np.ndarray) -> DataFrame:
    """Both views of all rows but those of the labelled sample, a chunk of documents a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.isin(batch.column("doc_id").fill_null(0).to_numpy(), labelled)
            known &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for _, text, meta in _views(batch.filter(pa.array(~known))):
                yield pa.RecordBatch.from_pylist([_packed("t", text) | _packed("m", meta)])

    schema = ", ".join(f"{view}{name} binary" for view in "tm" for name in "ivf")
    return stored(_cast(docs).mapInArrow(run, schema), "features")


def _taught(table: DataFrame, weights: list[np.ndarray], parts: list[np.ndarray]) -> DataFrame:
    """What each view learns in a round: the rows of which the other one is sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                chunk = batch.slice(k, 1).to_pylist()[0]
                views, out = [_unpacked(v, chunk) for v in "tm"], {}
                for prefix, own, other in (("t", 0, 1), ("m", 1, 0)):
                    part = parts[other][_bin(views[other].dot(weights[other]))]
                    rows = np.flatnonzero(part)
                    out |= _packed(prefix, views[own].take(rows), p=part[rows])
                yield pa.RecordBatch.from_pylist([out])

    schema = ", ".join(f"{view}{name} binary" for view in "tm" for name in "ivfp")
    return stored(table.mapInArrow(run, schema), "taught")


def co_train(text: Rows, meta: Rows, y: np.ndarray, unlabelled: Callable[[], DataFrame]) -> Model:
    """Both models from labelled rows (y is 0 or 1) and the chunks of all unlabelled ones."""
    at = np.arange(len(y))
    held, fit = at % HELD_OUT == 0, at % HELD_OUT != 0
    if len(set(y[fit])) < 2 or len(set(y[held])) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        none = (0.0, float(np.log(share / (1 - share))))
        return Model(np.zeros(TEXT_SIZE + 1), np.zeros(META_SIZE + 1), none, none, none[1])
    sizes = (TEXT_SIZE, META_SIZE)
    views = [_Learner(v.take(at[fit]), y[fit], s) for v, s in zip((text, meta), sizes, strict=True)]
    for view in views:
        for _ in range(EPOCHS):
            view.step()
    share, table = y[fit].mean(), unlabelled()
    for k in range(1, ROUNDS + 1):
        weights = [v.weights for v in views]

        def count(chunk: dict, weights=weights) -> np.ndarray:
            bins = [_bin(_unpacked(v, chunk).dot(w)) for v, w in zip("tm", weights, strict=True)]
            return np.concatenate([np.bincount(b, minlength=BINS) for b in bins])

        counts = np.split(_summed(table, count, 2 * BINS), 2)
        if not counts[0].any():
            break
        taught = _taught(table, weights, [_parts(c, GROWTH * k, share) for c in counts])
        for _ in range(STEPS):
            weights = [v.weights for v in views]

            def slopes(chunk: dict, weights=weights) -> np.ndarray:
                out = []
                for v, w, size in zip("tm", weights, sizes, strict=True):
                    part = np.frombuffer(chunk[v + "p"])
                    out.append(_slope(_unpacked(v, chunk), part > 0, np.abs(part), w, size))
                return np.concatenate(out)

            sums = np.split(_summed(taught, slopes, sum(sizes) + 2), [TEXT_SIZE + 1])
            for view, pseudo in zip(views, sums, strict=True):
                view.step(pseudo, PSEUDO * k)
    models = [v.weights for v in views]
    scales = [_scaled(rows.take(at[held]).dot(m), y[held])
              for rows, m in zip((text, meta), models, strict=True)]
    prior = float(np.log(share / (1 - share)))
    return Model(*models, *scales, prior)


def scores(model: Model, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probability of good quality by text, by metadata, and by both.

    Both views' log-odds hold the prior once each, so one is taken away from their sum.
    """
    left = model.text_scale[0] * text.dot(model.text) + model.text_scale[1]
    right = model.meta_scale[0] * meta.dot(model.meta) + model.meta_scale[1]
    return _sigmoid(left), _sigmoid(right), _sigmoid(left + right - model.prior)


def _cast(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:4],
                       F.col("n_chars").cast("long").alias("n_chars"))


def _sample(docs: DataFrame, labels: DataFrame, labelled: int) -> pa.Table:
    """Bounded features: labelled rows with their labels."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(labelled)
    rows = docs.select(*COLUMNS).join(some, F.col("doc_id") == F.col("id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, *views in _views(batch):
                columns = [batch.column("doc_id")[some], batch.column("quality")[some]]
                for rows in views:
                    first = pa.array(rows.first.astype(np.int32))
                    for values in (rows.index.astype(np.int32), rows.value.astype(np.float32)):
                        columns.append(pa.ListArray.from_arrays(first, pa.array(values)))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "ti", "tv", "mi", "mv"])

    schema = "id long, y int, ti array<int>, tv array<float>, mi array<int>, mv array<float>"
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:4],
                       F.col("n_chars").cast("long").alias("n_chars"),
                       F.col("quality").cast("int").alias("quality"))
    return rows.mapInArrow(features, schema).orderBy(F.xxhash64("id"), "id").toArrow()


def _read(table: pa.Table, index: str, value: str) -> Rows:
    lists = table[index].combine_chunks()
    sizes = np.asarray(lists.value_lengths(), np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    values = np.asarray(table[value].combine_chunks().flatten(), np.float64)
    return Rows(np.asarray(lists.flatten(), np.int64), values, first)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    table = _sample(docs, labels, labelled)
    ids, y = table["id"].to_numpy(), (table["y"].to_numpy() > 0).astype(float)
    text, meta = _read(table, "ti", "tv"), _read(table, "mi", "mv")
    return co_train(text, meta, y, lambda: _unlabelled(docs, ids))


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, the score of each view and of both, and whether the document is kept."""
    fitted = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, text, meta in _views(batch):
                left, right, both = scores(fitted, text, meta)
                columns = [batch.column("doc_id")[some], left, right, both, both >= KEEP]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return _cast(docs).mapInArrow(run, SCHEMA)
