"""Quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators: byte n-grams of the text and n-grams of
word forms (which kinds of characters a word has, and whether it repeats the
word before it), hashed to a fixed number of features.  Indicators are scaled
by the log-count ratio of the two classes, and a linear hinge-loss model is fit
to the scaled indicators by dual coordinate descent.  A logistic curve fit to
margins of rows that were left out of that turns margins into scores.

The model is fit on at most ``sample`` labelled rows, the ones that come first
in the order of a hash of their id.  One task gets a bounded number of rows
for that, of each only its distinct features, and the driver gets the model
alone.  Scoring reads whole texts.

Defined results: a null or empty text has no feature and gets the score of the
bare intercept; ties between equal hashes are broken by id; rows repeated with
one id are scored one by one, and the least of their feature sets is learnt; without rows of both labels every score is 0.5;
an empty table gives no rows; other columns are no inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm import arrowtext as A

FEATURES = 1 << 18
#: Labelled rows that the model is fit on at most.
SAMPLE = 12_000
BYTE_ORDERS = (1, 2, 3)
FORM_ORDERS = (1, 2, 3)

_U = np.uint64
# Character kinds as bits: lower case, upper case, digit, letter bytes beyond ASCII, full stop and comma, bang, other.
_KIND = np.zeros(256, np.uint16)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[128:] = 8
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 16
_KIND[ord("!")] = 32
_KIND[(_KIND == 0) & ~A.WHITE] = 64


def _ngrams(symbols: np.ndarray, order: int, salt: int) -> np.ndarray:
    total = np.full(max(0, len(symbols) - order + 1), _U(salt))
    for k in range(order):
        total = total * _U(0x100000001B3) + symbols[k : len(symbols) - order + 1 + k]
    return (A.mix(total) % _U(FEATURES)).astype(np.uint32)


def _word_forms(data: np.ndarray) -> np.ndarray:
    hashes, starts, _ = A._hash_piece(data, np.zeros(0, np.int64))
    if not len(hashes):
        return hashes
    kinds = np.bitwise_or.reduceat(_KIND[data] * ~A.WHITE[data], starts).astype(np.uint64)
    same = np.zeros(len(hashes), np.uint64)
    same[1:] = hashes[1:] == hashes[:-1]
    head = _KIND[data[starts]].astype(np.uint64)
    return kinds | (same << _U(8)) | (head << _U(9))


def features(data: np.ndarray) -> np.ndarray:
    """Sorted distinct features of one text, taken in pieces of bounded size."""
    found = [np.zeros(0, np.uint32)]
    for at in range(0, len(data), A.SLICE_BYTES):
        piece = data[at : at + A.SLICE_BYTES]
        symbols = piece.astype(np.uint64) + _U(1)
        found += [_ngrams(symbols, n, 11 + n) for n in BYTE_ORDERS]
        forms = _word_forms(piece) + _U(1)
        found += [_ngrams(forms, n, 101 + n) for n in FORM_ORDERS]
        if len(found) > 12:
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found))


@dataclass(frozen=True)
class Model:
    """weights per feature (ratio folded in), intercept, and the logistic curve on the margin."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        """Probability-like score of a set of features, 0.5 for the curve's middle."""
        margin = self.margin(found)
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * margin + self.shift))))

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.intercept
        return float(self.weights[found].sum() / math.sqrt(len(found)) + self.intercept)


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each feature in class 1 over that in class 0."""
    counts = [np.full(FEATURES, smoothing), np.full(FEATURES, smoothing)]
    for found, label in zip(rows, labels, strict=True):
        counts[int(label)][found] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: Sequence[np.ndarray], signs: np.ndarray, *, cost: np.ndarray, passes: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss; one dual variable per row, updated one at a time."""
    w, b = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(values[i] @ values[i]) + 1.0 for i in range(len(rows))])
    order = np.random.default_rng(seed)
    for _ in range(passes):
        largest = 0.0
        for i in order.permutation(len(rows)):
            value = values[i]
            gradient = signs[i] * (float(w[rows[i]] @ value) + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                largest = max(largest, abs(step))
                alpha[i] = new
                w[rows[i]] += step * signs[i] * value
                b += step * signs[i]
        if largest < 1e-3:
            break
    return w, b


def fit_curve(margins: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic regression of the label on the margin, by Newton steps on smoothed targets."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -500, 500)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gc = float((d * margins).sum()) + 1e-3 * a, float(d.sum())
        haa, hac, hcc = float((h * margins * margins).sum()) + 1e-3, float((h * margins).sum()), float(h.sum()) + 1e-9
        det = haa * hcc - hac * hac
        if det <= 1e-12:
            break
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        a, c = a - np.clip(da, -2, 2), c - np.clip(dc, -2, 2)
        if abs(da) + abs(dc) < 1e-8:
            break
    return (float(a), float(c)) if a > 0 else (1.0, 0.0)


class Scaled:
    """The indicators of each row scaled by the ratio and to unit length, made anew at each access."""

    def __init__(self, ratio: np.ndarray, rows: list[np.ndarray]) -> None:
        self._ratio, self._rows = ratio, rows

    def __len__(self) -> int:
        return len(self._rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return self._ratio[self._rows[i]] / math.sqrt(max(1, len(self._rows[i])))


def fit(rows: list[np.ndarray], labels: np.ndarray, *, strength: float = 1.0) -> Model:
    """The classifier of rows of features with labels 0 and 1."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(FEATURES, np.float32), 0.0, 1.0, 0.0)
    ratio = log_count_ratio(rows, labels)
    signs = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, (labels == 1).mean(), (labels == 0).mean())
    cost = strength * 0.5 / share  # both classes weigh the same

    inner = np.arange(len(rows)) % 5 != 0
    if len(set(labels[inner].tolist())) == 2 and len(set(labels[~inner].tolist())) == 2:
        known = [r for r, k in zip(rows, inner, strict=True) if k]
        w, b = dual_coordinate_descent(known, Scaled(ratio, known), signs[inner], cost=cost[inner])
        left = [r for r, k in zip(rows, inner, strict=True) if not k]
        margins = np.array([float(w[r] @ v) + b for r, v in zip(left, Scaled(ratio, left))])
        slope, shift = fit_curve(margins, labels[~inner])
    else:
        slope, shift = 1.0, 0.0
    w, b = dual_coordinate_descent(rows, Scaled(ratio, rows), signs, cost=cost)
    return Model((w * ratio).astype(np.float32), b, slope, shift)


def text_features(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    data, offsets = A.text_buffers(batch.column(column))
    for i in range(len(offsets) - 1):
        yield features(data[offsets[i] : offsets[i + 1]])


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label, found) of at most ``sample`` labelled documents outside the held-out part."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("long").alias("label"))
    known = known.where(~held_out).withColumn("order", F.xxhash64("doc_id", F.lit(17))).orderBy("order", "doc_id").limit(sample).select("doc_id", "label")
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")  # at most ``sample`` rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.tobytes() for f in text_features(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    found = picked.select("doc_id", "text", "label").mapInArrow(work, "doc_id long, label long, found binary")
    return found.groupBy("doc_id", "label").agg(F.min("found").alias("found"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; the model is of a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(f) for f in text_features(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double")


def held_out_quality(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled rows, fit in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("label", pa.int64()), ("found", pa.binary())]))
        rows = [np.frombuffer(x.as_buffer(), np.uint32) for x in got["found"]]
        order = np.argsort(np.asarray(got["doc_id"]), kind="stable")
        model = fit([rows[i] for i in order], np.asarray(got["label"])[order])
        columns = ([model.weights.tobytes()], [model.intercept], [model.slope], [model.shift])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), *[pa.float64()] * 3), strict=True)], ["weights", "intercept", "slope", "shift"])

    rows = labelled_features(docs, labels, label, held_out_quality(), sample).repartition(1)  # at most ``sample`` rows
    got = rows.mapInArrow(work, "weights binary, intercept double, slope double, shift double").first()
    if got is None:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(got["weights"], np.float32), got["intercept"], got["slope"], got["shift"])


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text the model scores at ``threshold`` or more, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(f) >= threshold for f in text_features(batch, at)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
