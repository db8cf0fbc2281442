"""Language identification by a byte convolutional network in numpy.

Texts are cut into windows of a fixed number of bytes.  Filters of several
widths slide over the bytes of a window, each filter keeps its largest value,
and a softmax layer turns these into languages.  A text's prediction adds up
the log-probabilities of all its windows.

A filter over one-hot bytes is a sum of table look-ups, one per position, and
two positions next to each other are one look-up in a table of byte pairs.
Scoring therefore needs no matrix product over bytes.

The network is fit on at most ``sample`` labelled rows (first in the order of a
hash of their id), on all windows of each, in one task; the driver gets the
network alone.  A text weighs by the root of its number of windows, and
languages weigh the same.
Scoring reads whole texts, a bounded number of windows at a time.

Defined results: a null text or one without a letter is ``und`` with score 0;
a text shorter than a window is padded with spaces; repeated rows are predicted
one by one, and of those with one id the least (lang, text) is learnt; without
labelled rows every text is ``und``; an empty table gives no rows; lang, source
and doc_id are no inputs, and other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm import arrowtext as A

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Labelled rows that the network is fit on at most.
SAMPLE = 6_000
#: Passes over all windows, and training steps at least, for small samples.
EPOCHS = 2
LEAST_STEPS = 300
#: Windows that are scored in one step.
STEP = 2_048
_LETTER = regex.compile(r"\p{L}")
_PAD = max(WIDTHS)


@dataclass(frozen=True)
class Network:
    """languages, filters[width] (width, 256, FILTERS), softmax weights and biases."""

    languages: tuple[str, ...]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums over byte pairs for positions (0, 1) and (2, 3) of all filters side by side."""
        pair = [np.zeros((256, 256, len(WIDTHS) * FILTERS), np.float32) for _ in range(2)]
        for k, width in enumerate(WIDTHS):
            at = slice(k * FILTERS, (k + 1) * FILTERS)
            for p in range(width):
                part = self.filters[width][p]
                pair[p // 2][:, :, at] += part[:, None, :] if p % 2 == 0 else part[None, :, :]
        return pair[0].reshape(65536, -1), pair[1].reshape(65536, -1)


def cut(data: np.ndarray) -> np.ndarray:
    """Windows of one text, each with _PAD bytes of the next so that no n-gram is lost."""
    n = max(1, -(-len(data) // WINDOW))
    padded = np.full(n * WINDOW + _PAD, 0x20, np.uint8)
    padded[: len(data)] = A.LOWER[data]
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW + _PAD), (WINDOW, 1))


def _pooled(windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray], bias: np.ndarray) -> np.ndarray:
    wide = windows.astype(np.int32)
    pairs = (wide[:, :-1] << 8) | wide[:, 1:]
    values = tables[0][pairs[:, :WINDOW]]
    values += tables[1][pairs[:, 2 : WINDOW + 2]]
    return np.maximum(values.max(axis=1) + bias, 0)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def fit(texts: list[np.ndarray], languages: list[str], *, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the cross entropy of all windows of the texts; gradients go to the position that won the pooling."""
    names = tuple(sorted(set(languages)))
    rng = np.random.default_rng(seed)
    pieces = [cut(text) for text in texts]
    of_text = np.array([names.index(lang) for lang in languages])
    many = np.array([len(p) for p in pieces])
    x, y = np.concatenate(pieces), np.repeat(of_text, many)
    share = 1.0 / np.repeat(np.sqrt(many), many)  # a long text counts more than a short one, but not by its length
    weight = share / np.bincount(y, weights=share, minlength=len(names))[y] * len(y) / len(names)
    width_of = {w: rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS}
    params = [*(width_of[w] for w in WIDTHS), np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names))), np.zeros(len(names))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, per_epoch = 0, max(1, len(x) // batch)
    for _ in range(max(epochs, -(-LEAST_STEPS // per_epoch))):
        for rows in np.array_split(rng.permutation(len(x)), per_epoch):
            net = Network(names, dict(zip(WIDTHS, params[:3], strict=True)), params[3], params[4], params[5])
            wide = x[rows].astype(np.int64)
            best, hidden = [], []
            for k, w in enumerate(WIDTHS):
                conv = sum(net.filters[w][p][wide[:, p : p + WINDOW]] for p in range(w))
                at = conv.argmax(axis=1)
                best.append(at)
                hidden.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0, :] + net.bias[k * FILTERS : (k + 1) * FILTERS])
            raw = np.concatenate(hidden, axis=1)
            act = np.maximum(raw, 0)
            p = np.exp(log_softmax(act @ net.dense + net.offset))
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows, None] / len(rows)
            back = (p @ net.dense.T) * (raw > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g, grad = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(params[k])
                for q in range(w):
                    chars = np.take_along_axis(wide, best[k] + q, 1)
                    np.add.at(grad[q], (chars, np.arange(FILTERS)[None, :]), g)
                grads.append(grad)
            grads += [back.sum(axis=0), act.T @ p + 1e-4 * net.dense, p.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    small = [p.astype(np.float32) for p in params]
    return Network(names, dict(zip(WIDTHS, small[:3], strict=True)), *small[3:])


def text_scores(net: Network, tables: tuple[np.ndarray, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean log-probability per language of each text of a slice."""
    total = np.zeros((len(offsets) - 1, len(net.languages)))
    windows, owner, held = [], [], 0
    many = np.maximum(1, -(-np.diff(offsets) // WINDOW))

    def flush() -> None:
        logs = log_softmax(_pooled(np.concatenate(windows), tables, net.bias) @ net.dense + net.offset)
        np.add.at(total, np.concatenate(owner), logs)

    for i in range(len(offsets) - 1):
        mine = cut(data[offsets[i] : offsets[i + 1]])
        for at in range(0, len(mine), STEP):
            part = mine[at : at + STEP]
            windows.append(part)
            owner.append(np.full(len(part), i))
            held += len(part)
            if held >= STEP:
                flush()
                windows, owner, held = [], [], 0
    if windows:
        flush()
    return total / many[:, None]


def held_out_language(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network of at most ``sample`` labelled rows outside the held-out part, fit in one task."""
    doc_id, lang, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    known = docs.select(doc_id, lang, text).where("doc_id is not null and lang is not null and text is not null").where(~held_out_language())
    first = known.select("doc_id").distinct().withColumn("order", F.xxhash64("doc_id", F.lit(29))).orderBy("order", "doc_id").limit(sample).select("doc_id")
    rows = known.join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.lang", "row.text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, texts = [], [], []
        for batch in batches:
            data, offsets = A.text_buffers(batch.column(2))
            ids += batch.column(0).to_pylist()
            names += batch.column(1).to_pylist()
            texts += [data[offsets[i] : offsets[i + 1]].copy() for i in range(len(offsets) - 1)]
        if ids:
            order = sorted(range(len(ids)), key=ids.__getitem__)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([texts[i] for i in order], [names[i] for i in order]))], pa.binary())], ["network"])

    got = rows.repartition(1).mapInArrow(work, "network binary").first()  # at most ``sample`` rows
    return pickle.loads(got["network"]) if got else None


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if model else None
        for batch in batches:
            data, offsets = A.text_buffers(batch.column(1))
            names, scores = [], []
            for first, last in A.row_slices(offsets):
                at = offsets[first : last + 1] - offsets[first]
                part = data[offsets[first] : offsets[last]]
                logs = text_scores(model, tables, part, at) if model else np.zeros((last - first, 1))
                top = logs.argmax(axis=1)
                chance = np.exp(log_softmax(logs))[np.arange(len(top)), top]
                for i in range(last - first):
                    known = model is not None and _LETTER.search(batch.column(1)[first + i].as_py() or "")
                    names.append(model.languages[top[i]] if known else "und")
                    scores.append(float(chance[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, lang_pred string, score double")
