"""Operator 10: quality classifier, a factorisation machine.

Inputs of a text are its hashed words (square root of the count, unit length),
statistics of its structure and its length, each cut into steps and hashed in
the same way.  The score is

    logistic(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

and the pairwise part is taken in linear time as half of
|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2.

Learning takes at most `PER_CLASS` labelled rows of either class that are not
held out, on the driver, in minibatches with AdaGrad; the rows' inputs are made
on the executors.  Scoring is one pass without a shuffle; the model has
2**BITS * (RANK + 1) numbers, a fixed size, and is broadcast.

Labels, language, source and id are no inputs.  Defined cases: a null or empty
text has the statistics of zero words; without labelled rows of both classes
every score is the share of good labels (1 without any); repeated rows get a
row each; a null doc_id is not held out; a text of any length is read whole, in
memory of some times its size; an empty table gives no rows; a column of the
name of the score is refused, all others pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.llm.frames import append, class_sizes, free_name, is_held_out, labelled_sample, two_columns
from kinforge.llm.ragged import SEP, chunks, counts, hash_slices, mix, padded, per_row, window_hash, words

MODULUS, HELD_OUT = 3, 1
PER_CLASS = 4096
#: Steps of learning, each over a batch of rows, and rows in a batch; alike for every size of sample.
FIT_STEPS, FIT_BATCH = 512, 128
BITS, RANK = 15, 8
#: Weight of a statistic beside the words' unit length.
STAT_VALUE = 0.5

_CLASSES = {
    "upper": [b for b in range(128) if chr(b).isupper()],
    "lower": [b for b in range(128) if chr(b).islower()],
    "digit": [b for b in range(128) if chr(b).isdigit()],
    "symbol": list(b"#*$%&|<>{}[]\\^~=_@"),
    "stop": list(b".,;:!?\"'()-"),
    "shout": list(b"!?"),
    "line": [10],
    "high": list(range(0xC0, 256)),
    "blank": np.flatnonzero(SEP).tolist(),
}
_MASKS = {k: np.isin(np.arange(256), v) for k, v in _CLASSES.items()}
#: Steps of a share.
_EDGES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.035, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.65, 0.8, 0.95])


def statistics(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step numbers of the structure statistics: one line for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    n_words = counts(row, n)
    share = {}
    for name, mask in _MASKS.items():
        running = np.append(0, np.cumsum(mask[data]))
        share[name] = (running[offsets[1:]] - running[offsets[:-1]]) / np.maximum(size, 1)
    letters = np.maximum(share["upper"] + share["lower"], 1e-9)
    key = mix(h ^ mix(row.astype(np.uint64)))  # a word of a row
    distinct = np.unique(key, return_index=True)[1]
    new = counts(row[distinct], n) / np.maximum(n_words, 1)
    five = window_hash(h, 5)
    at = np.flatnonzero(row[: len(five)] == row[4:]) if len(five) else np.zeros(0, np.int64)
    fresh = np.unique(mix(five[at] ^ mix(row[at].astype(np.uint64))), return_index=True)[1]
    repeated = 1 - counts(row[at][fresh], n) / np.maximum(counts(row[at], n), 1)
    repeated[counts(row[at], n) == 0] = 0
    width = per_row(end - start, row, n) / np.maximum(n_words, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    steps = [
        *(np.searchsorted(_EDGES, share[k], side="right") for k in ("digit", "symbol", "stop", "shout", "line", "high", "blank")),
        np.searchsorted(_EDGES, share["upper"] / letters, side="right"),
        np.searchsorted(_EDGES, 1 - new, side="right"),
        np.searchsorted(_EDGES, repeated, side="right"),
        np.searchsorted(_EDGES, counts(row[same], n) / np.maximum(n_words, 1), side="right"),
        np.minimum(width * 2, 40).astype(np.int64),
        np.ceil(2 * np.log2(n_words + 1)).astype(np.int64),
        np.ceil(2 * np.log2(size + 1)).astype(np.int64),
    ]
    return np.stack(steps, axis=1)


def inputs(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the model, value) of all inputs, by row."""
    n = len(offsets) - 1
    start, end, row = words(data, offsets)
    h, _ = hash_slices(padded(data), start, end)
    cell, count = np.unique((row << bits) | (h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    owner = cell >> bits
    value = np.sqrt(count / np.maximum(counts(row, n), 1)[owner])
    steps = statistics(data, offsets, start, end, row, h)
    name = (np.arange(steps.shape[1]) * 1000 + 1)[None, :] + steps
    place = (mix(name.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    rows = np.concatenate([owner, np.repeat(np.arange(n), steps.shape[1])])
    places = np.concatenate([cell & ((1 << bits) - 1), place.ravel()])
    values = np.concatenate([value, np.full(place.size, STAT_VALUE)])
    order = np.argsort(rows, kind="stable")
    return rows[order], places[order], values[order].astype(np.float32)


class Machine:
    """Factorisation machine; w0, w and v are its numbers."""

    def __init__(self, bits: int = BITS, rank: int = RANK, seed: int = 7):
        self.bits = bits
        self.w0 = 0.0
        self.w = np.zeros(1 << bits, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (1 << bits, rank)).astype(np.float32)

    def raw(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum before the logistic function, sum of v x by row, v x); rows must be in order and none empty."""
        head = np.searchsorted(row, np.arange(n))
        vx = self.v[place] * value[:, None]
        total = np.add.reduceat(vx, head, axis=0)
        linear = np.add.reduceat(self.w[place] * value, head)
        square = np.add.reduceat((vx * vx).sum(axis=1), head)
        return self.w0 + linear + 0.5 * ((total * total).sum(axis=1) - square), total, vx

    def fit(self, offsets: np.ndarray, place: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, n_steps: int = FIT_STEPS, batch: int = FIT_BATCH, rate: float = 0.08, ridge: float = 2e-5) -> None:
        """AdaGrad on the weighted logistic loss; offsets: where each row's inputs begin."""
        rng = np.random.default_rng(11)
        sum_w, sum_v, sum_0 = np.full(self.w.shape, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        left = n_steps
        while left > 0:
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch)[:left]:
                left -= 1
                pick = order[a : a + batch]
                size = offsets[pick + 1] - offsets[pick]
                at = np.repeat(offsets[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                row, p, x = np.repeat(np.arange(len(pick)), size), place[at], value[at]
                z, total, vx = self.raw(row, p, x, len(pick))
                slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
                each = (slope[row] * x).astype(np.float32)
                cells, inverse = np.unique(p, return_inverse=True)
                grad_w = np.bincount(inverse, weights=each).astype(np.float32) + ridge * self.w[cells]
                push = each[:, None] * (total[row] - vx)
                by_cell = np.argsort(inverse, kind="stable")
                grad_v = np.add.reduceat(push[by_cell], np.searchsorted(inverse[by_cell], np.arange(len(cells))), axis=0) + ridge * self.v[cells]
                sum_w[cells] += grad_w**2
                sum_v[cells] += grad_v**2
                self.w[cells] -= rate * grad_w / np.sqrt(sum_w[cells])
                self.v[cells] -= 0.3 * rate * grad_v / np.sqrt(sum_v[cells])
                sum_0 += float(slope.sum()) ** 2
                self.w0 -= rate * float(slope.sum()) / sum_0**0.5

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for a, b, data, offsets in chunks(texts):
            row, place, value = inputs(data, offsets, self.bits)
            z, _, _ = self.raw(row, place, value, b - a)
            out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | float:
    """A machine learned from rows that are not held out, or a constant score."""
    sizes = class_sizes(labels, "quality", MODULUS, HELD_OUT)
    if not all(sizes):
        return sizes[1] / sum(sizes) if sum(sizes) else 1.0
    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, per_class)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, data, offsets in chunks(batch.column(1)):
                row, place, value = inputs(data, offsets)
                cuts = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(value)),
                    ],
                    names=["doc_id", "label", "place", "value"],
                )

    table = sample.mapInArrow(rows, "doc_id long, label int, place array<int>, value array<float>").toArrow().sort_by("doc_id")
    if not len(table):
        return sizes[1] / sum(sizes)
    lists = table["place"].combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    place, value = lists.values.to_numpy().astype(np.int64), table["value"].combine_chunks().values.to_numpy()
    y = table["label"].to_numpy().astype(np.float32)
    # the two classes weigh as they do among all labelled rows, at most 1 to 4
    share = np.clip(sizes[1] / sum(sizes), 0.2, 0.8)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)).astype(np.float32)
    machine = Machine()
    machine.fit(offsets, place, value, y, weight)
    return machine


def score(docs: DataFrame, model: Machine | float, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with one more column, its score."""
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, text_col, T.StructType([T.StructField(name, T.DoubleType())]), lambda texts: [pa.array(shared.value.scores(texts))])


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    out = score(two_columns(docs, "doc_id", "text"), learn(docs, labels, per_class))
    return out.select("doc_id", is_held_out("doc_id", MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of `docs` that reach the threshold, with the same columns."""
    name = free_name(docs, "quality")
    return score(docs, learn(docs, labels, per_class), name=name).filter(F.col(name) >= threshold).drop(name)
