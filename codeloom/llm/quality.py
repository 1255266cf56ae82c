"""Quality by ordinal cumulative-link regression on graded ratings.

All grades share one weight for each of ``2^BITS`` hashed runs of ``GRAM`` bytes; the
probability of a grade of at most ``g`` is ``sigmoid(t_g - w * x)`` with ordered
thresholds ``t``. Counts of runs enter as logarithms and a text's vector has unit
length, so that texts of any length compare. The result is the expected grade and
the probability of the best grades, by which texts are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashed import grams, labelled
from .textnum import pieces, texts_of, trim

BITS = 11
GRAM = 3
#: The model is fitted on this many labelled documents at most, chosen by hash.
TRAIN_ROWS = 8192
STEPS = 400


@dataclass
class CumulativeLink:
    """The grades in order, the shared weights and the thresholds between neighbouring grades."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The probability of each grade, a row for each row of ``x``."""
        z = x @ self.weights
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))
        full = np.concatenate((np.zeros((len(z), 1)), upto, np.ones((len(z), 1))), axis=1)
        return np.diff(full, axis=1)


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = 1e-5) -> CumulativeLink:
    """Adam on the mean negative log-likelihood; thresholds stay ordered as sums of exponentials. One grade alone is always predicted."""
    grades = sorted(set(y.tolist()))
    k = len(grades)
    rank = np.searchsorted(grades, y)
    dim = x.shape[1]
    if k < 2:
        return CumulativeLink(grades or [0], np.zeros(dim), np.zeros(0))
    share = np.cumsum(np.bincount(rank, minlength=k))[:-1] / len(y)
    t = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(dim), [t[0]], np.log(np.maximum(np.diff(t), 1e-3))))
    first, second = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(len(y))
    for step in range(1, steps + 1):
        gaps = np.exp(np.clip(p[dim + 1 :], -20, 20))
        t = p[dim] + np.concatenate(([0.0], np.cumsum(gaps)))
        z = x @ p[:dim].astype(x.dtype)
        bound = np.concatenate((np.full((len(y), 1), -np.inf), t[None, :] - z[:, None], np.full((len(y), 1), np.inf)), axis=1)
        s = 1 / (1 + np.exp(-np.clip(bound, -40, 40)))
        slope = s * (1 - s)
        likely = np.maximum(s[rows, rank + 1] - s[rows, rank], 1e-12)
        up, down = slope[rows, rank + 1] / likely / len(y), slope[rows, rank] / likely / len(y)  # of the upper and the lower threshold
        dt = np.bincount(rank, -up, k)[: k - 1] + np.bincount(rank, down, k)[1:]
        grad = np.concatenate(((x.T @ (up - down).astype(x.dtype)).astype(float) + ridge * p[:dim], [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps))
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        p = p - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    t = p[dim] + np.concatenate(([0.0], np.cumsum(np.exp(np.clip(p[dim + 1 :], -20, 20)))))
    return CumulativeLink(grades, p[:dim], t)


def vectors(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A unit vector for each text; that of a text too short for a run is zero."""
    h, bounds = grams(buf, offsets, GRAM, BITS)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    x = np.log1p(np.bincount((row << BITS) | h, minlength=n << BITS).reshape(n, 1 << BITS)).astype(np.float32)
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """``first text, end text, vectors`` of parts of a batch, of at most 256 texts each."""
    buf, offsets = texts_of(column)
    for a, b in pieces(offsets):
        for i in range(a, b, 256):
            j = min(b, i + 256)
            yield i, j, vectors(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, where: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> CumulativeLink:
    """Fit on at most ``rows`` labelled documents, of the labels that fulfil ``where`` (over ``id`` and ``y``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in _parts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], ["y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = [np.zeros(0, dtype=np.int64)], [b""]
        for batch in batches:
            y.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            x += batch.column(1).to_pylist()
        m = fit(np.frombuffer(b"".join(x), dtype="<f2").astype(np.float32).reshape(-1, 1 << BITS), np.concatenate(y))
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (np.array(m.grades, dtype=np.int64), m.weights, m.thresholds)], ["grades", "weights", "thresholds"])
        trim()

    # one task, of at most ``rows`` rows in an order that only depends on them
    sample = labelled(docs, labels, label, rows, where, id_col, text_col).mapInArrow(run, "y int, x binary")
    ordered = sample.withColumn("o", F.xxhash64("x")).repartition(1).sortWithinPartitions("y", "o", "x").select("y", "x")
    r = ordered.mapInArrow(learn, "grades binary, weights binary, thresholds binary").first()
    if r is None:  # no partition at all
        return fit(np.zeros((0, 1 << BITS), dtype=np.float32), np.zeros(0, dtype=np.int64))
    return CumulativeLink(np.frombuffer(r.grades, dtype=np.int64).tolist(), np.frombuffer(r.weights), np.frombuffer(r.thresholds))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", tail: int | None = None, id_col: str = "doc_id", text_col: str = "text", where: F.Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``<id>, expected_grade, tail_probability, predicted_grade, kept``.

    ``tail_probability`` is that of a grade of at least ``tail`` (the best grade, if not
    given), and ``kept`` says that it is 0.5 or more. Null and empty texts, and texts shorter than a
    run, are judged by the thresholds alone. Without labels all grades are 0; with one
    grade all texts have it. Rows that repeat have equal results; an empty table
    gives an empty result.
    """
    model = train(docs, labels, label, where=where, id_col=id_col, text_col=text_col)
    grades = np.array(model.grades, dtype=float)
    best = grades >= (grades[-1] if tail is None else tail)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in _parts(batch.column(1)):
                p = model.probabilities(x)
                high = p[:, best].sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p @ grades), pa.array(high), pa.array(grades[p.argmax(axis=1)].astype(np.int32)), pa.array(high >= 0.5)], ["id", "expected_grade", "tail_probability", "predicted_grade", "kept"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, expected_grade double, tail_probability double, predicted_grade int, kept boolean").withColumnRenamed("id", id_col)
