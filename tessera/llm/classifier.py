"""Quality classifier: naive Bayes support vectors.

Indicators of word n-grams (hashed to a fixed number of columns) are scaled by
the class log-count ratios, and a linear hinge-loss model is fitted by dual
coordinate descent. Alongside one- and two-word grams of the words themselves,
grams of word shapes (case, digits, marks) are taken, so that layout and junk
are seen for words never met before. A logistic map fitted on part of the
training rows turns margins into scores from 0 to 1.

The fit takes at most `max_train_rows` labelled rows, those with the smallest
hash of their id; every document is scored. The model is `2 ** bits` floats,
whatever the input's size, and is broadcast.

Defined cases: null and empty texts have no grams and get the score of the bias
alone; without training rows of both classes the score is the share of label 1
(or 0.5); labels other than 0 and 1 are left out; repeated rows are scored each, alike,
and of rows of one id the least text by code point is learned from;
ids may have any type and be null, and ids with equal hashes are taken by id, then
label; a very long text takes memory in proportion to itself; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

BITS = 18
MAX_TRAIN_ROWS = 8_000

#: Shape of a byte: lower, upper, digit, beyond ASCII, or one class for each mark.
_SHAPE = np.zeros(256, np.uint8)
for _i in range(256):
    _c = chr(_i)
    _SHAPE[_i] = 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _i >= 128 else _i


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Sorted distinct columns of each text of a chunk."""
    words, first = kernel.word_hashes(data, offsets)
    kinds = _SHAPE[data]
    spaces = kernel.SPACES[data]
    # The set of shapes in each word, as bits of a number.
    value = np.zeros(256, np.uint64)
    value[1:5] = [1, 2, 4, 8]
    for c in range(33, 127):
        if not chr(c).isalnum():
            value[c] = 16 << (c % 40)
    inside = ~spaces
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], spaces[:-1])) | inside & cut[:-1]) if len(data) else np.zeros(0, np.int64)
    masked = np.where(inside, value[kinds], np.uint64(0))
    shape = np.bitwise_or.reduceat(masked, starts) if len(starts) else np.zeros(0, np.uint64)
    shape = kernel.mix(shape + np.uint64(77))
    pair = kernel.mix(words[:-1] * np.uint64(3) + kernel.mix(words[1:]))
    shape_pair = kernel.mix(shape[:-1] * np.uint64(5) + kernel.mix(shape[1:]))
    top = np.uint64(64 - bits)
    columns = [(x >> top).astype(np.int32) for x in (words, shape, pair, shape_pair)]
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = [columns[0][low:high], columns[1][low:high]]
        if high - low > 1:
            own += [columns[2][low : high - 1], columns[3][low : high - 1]]
        # How much of the text each shape and the commonest word take, in steps.
        if high > low:
            _, counts = np.unique(shape[low:high], return_counts=True)
            kinds_of, at = np.unique(shape[low:high], return_index=True)
            steps = np.floor(8 * counts / (high - low)).astype(np.uint64)
            own.append((kernel.mix(kinds_of * np.uint64(11) + steps) >> top).astype(np.int32))
            distinct = len(np.unique(words[low:high]))
            step = np.array([int(10 * distinct / (high - low)) * 64 + int(np.log2(high - low))], np.uint64)
            own.append((kernel.mix(step + np.uint64(10**6)) >> top).astype(np.int32))
            own.append((kernel.mix(step // np.uint64(64) + np.uint64(10**9)) >> top).astype(np.int32))
        out.append(np.unique(np.concatenate(own)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int

    def margin(self, columns: np.ndarray) -> float:
        if not len(columns):
            return self.bias
        return float(self.weights[columns].sum()) / np.sqrt(len(columns)) + self.bias

    def score(self, columns: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(columns) + self.offset, -30, 30))))


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12, seed: int = 1
) -> tuple[np.ndarray, float]:
    """Linear support vectors with squared hinge loss: the dual's coordinates in
    turn, each to its own optimum. The bias is a column of ones."""
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values]) + 0.5 / cost
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, v, y = rows[i], values[i], signs[i]
            gradient = y * (float(weights[at] @ v) + bias) - 1 + 0.5 * alpha[i] / cost[i]
            if alpha[i] == 0 and gradient >= 0:
                continue
            new = max(alpha[i] - gradient / norms[i], 0.0)
            step = (new - alpha[i]) * y
            if step:
                weights[at] += step * v
                bias += step
                alpha[i] = new
                worst = max(worst, abs(gradient))
        if worst < 1e-3:
            break
    return weights, bias


def _platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic map, by Newton steps on smoothed targets."""
    positive = labels.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(columns: list[np.ndarray], labels: np.ndarray, bits: int = BITS, smoothing: float = 1.0, cost: float = 1.0) -> Model:
    size = 1 << bits
    labels = labels.astype(int)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) < 10 or labels.min() == labels.max():
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))), bits)
    counts = np.full((2, size), smoothing)
    for at, y in zip(columns, labels, strict=True):
        counts[y, at] += 1
    totals = np.array([(labels == k).sum() for k in (0, 1)]) + 2 * smoothing
    ratio = np.log(counts[1] / totals[1]) - np.log(counts[0] / totals[0])
    scaled = [ratio[at] / np.sqrt(max(1, len(at))) for at in columns]
    signs = 2 * labels - 1
    costs = np.full(len(labels), cost)
    # A fifth is held back to map margins to scores; the final model takes all rows.
    held = np.arange(len(labels)) % 5 == 0
    inner = np.flatnonzero(~held)
    w, b = dual_coordinate_descent([columns[i] for i in inner], [scaled[i] for i in inner], signs[inner], size, costs[inner])
    margins = np.array([float(w[columns[i]] @ scaled[i]) + b for i in np.flatnonzero(held)])
    if len(set(labels[held].tolist())) == 2:
        a, c = _platt(margins, labels[held])
    else:
        a, c = 1.0, float(np.log(share / (1 - share)))
    if a <= 0:
        a, c = 1.0, float(np.log(share / (1 - share)))
    w, b = dual_coordinate_descent(columns, scaled, signs, size, costs)
    return Model((w * ratio).astype(np.float32).astype(np.float64), b, a, c, bits)


def _columns_of(texts: pa.Array, bits: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in kernel.chunks(texts):
        out += features(data, offsets, bits)
    return out


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, bits: int = BITS) -> Model:
    """docs: doc_id, text. labels: doc_id, label (0 or 1; others are left out).

    The rows to train on are chosen among the labels alone, so that no text but
    theirs moves; being at most `max_train_rows`, they are broadcast.
    """
    some = (
        labels.where(F.col("label").isin(0, 1))
        .select("doc_id", F.col("label").cast("int").alias("label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_train_rows)
    )
    # Of rows of one id the least text, so that copies of an id are no more rows than labels.
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _columns_of(batch.column(0), bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in own], pa.binary()), batch.column(1)], ["columns", "label"]
            )

    rows = chosen.mapInArrow(featurize, "columns binary, label int").collect()
    return fit([np.frombuffer(r["columns"], np.int32) for r in rows], np.array([r["label"] for r in rows], int), bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(x) for x in _columns_of(batch.column(1), own.bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
