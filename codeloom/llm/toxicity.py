"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text in lower case, hashed to ``2^BITS`` buckets; a text has a term or
hasn't, so that its length adds nothing to its score. All terms of the training texts go to the
machine: it has a weight for each term and a vector of ``RANK`` factors, whose inner products weigh pairs of
terms that a text has both; an insult that only counts when a group is named beside it is such a pair.

Weights and factors are learnt by follow-the-regularised-leader with an L1 penalty (McMahan et al. 2013), which
keeps a number at zero as long as the gradients for it are no more than what ``EVIDENCE`` (``PAIR_EVIDENCE``) toxic texts say in all
epochs. Factors join after ``ALONE`` epochs of weights alone, when what is left to explain isn't the work of single terms. They
must begin at random, as zeros never move; after two more epochs that start is withdrawn, so that only factors
for which the data speak remain. A text moves a factor by no more than one term alone would, so that long texts
don't learn themselves by heart.

The machine is fitted in one task on a sample of bounded size. What isn't zero in it is small, and goes to
the tasks that score whole texts in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashed import labelled, terms
from .textnum import pieces, texts_of, trim

BITS = 20
RANK = 4
#: The model is fitted on this many labelled documents at most, chosen by hash.
TRAIN_ROWS = 20_000
EPOCHS = 14
ALONE = 8
EVIDENCE, PAIR_EVIDENCE = 1.34, 5.0
STEP = 0.1
START = 0.1
BATCH = 128


@dataclass
class Machine:
    """A fitted factorization machine: the bucket, weight and factors of each term that has any, and the bias."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The logit of each row of terms ``ids`` (numbers of buckets)."""
        s, squares = sums(self.factors[ids], bounds), sums(self.factors[ids] ** 2, bounds)
        return self.bias + sums(self.weights[ids], bounds) + 0.5 * (s**2 - squares).sum(axis=1)


def sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each run of ``x`` between ``bounds``, which only depends on that run."""
    out = np.zeros((len(bounds) - 1, *x.shape[1:]))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(x, bounds[:-1][full], axis=0)
    return out


class _Leader:
    """Follow-the-regularised-leader over an array of numbers: a number is zero while its sum of gradients is within ``penalty``."""

    def __init__(self, start: np.ndarray, penalty: float, step: float):
        self.value, self.penalty, self.step = start.copy(), penalty, step
        self.start = -(np.sign(start) * penalty + start / step)  # the sum that gives this value
        self.total, self.square = self.start.copy(), np.zeros_like(start)

    def _set(self, at: np.ndarray | slice) -> None:
        z = self.total[at]
        self.value[at] = np.where(np.abs(z) <= self.penalty, 0.0, -(z - np.sign(z) * self.penalty) * self.step / (1 + np.sqrt(self.square[at])))

    def update(self, at: np.ndarray, gradient: np.ndarray) -> None:
        old = self.square[at]
        new = old + gradient**2
        self.total[at] += gradient - (np.sqrt(new) - np.sqrt(old)) / self.step * self.value[at]
        self.square[at] = new
        self._set(at)

    def withdraw_start(self) -> None:
        self.total -= self.start
        self._set(slice(None))


def fit(buckets: np.ndarray, ids: np.ndarray, bounds: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, alone: int = ALONE, seed: int = 7) -> Machine:
    """Fit on rows of distinct terms ``ids`` (numbers of ``buckets``), both labels with equal weight; without rows, or with one class only, the score is the share of label 1."""
    rng = np.random.default_rng(seed)
    n, k = len(y), len(buckets)
    share = (float(y.sum()) + 0.5) / (n + 1)
    if n == 0 or y.min() == y.max() or k == 0:
        return Machine(buckets[:0], float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, rank)))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = _Leader(np.zeros(k), EVIDENCE * epochs * weight.max(), STEP)
    v = _Leader(rng.normal(0, START, (k, rank)), PAIR_EVIDENCE * (epochs - alone) * weight.max(), STEP)
    bias, square = 0.0, 1e-2
    for epoch in range(epochs):
        pairs = rank > 0 and epoch >= alone
        if rank and epoch == alone + 2:
            v.withdraw_start()
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            rows = order[a : a + BATCH]
            count = np.diff(bounds)[rows]
            b = np.concatenate(([0], np.cumsum(count)))
            x = ids[np.repeat(bounds[rows] - b[:-1], count) + np.arange(b[-1])]
            z = bias + sums(w.value[x], b)
            if pairs:
                factors = v.value[x]
                s = sums(factors, b)
                z = z + 0.5 * (s**2 - sums(factors**2, b)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows]
            row = np.repeat(np.arange(len(rows)), count)
            seen, at = np.unique(x, return_inverse=True)
            w.update(seen, np.bincount(at, g[row], len(seen)))
            if pairs:
                others = np.clip(s[row] - factors, -1, 1) * g[row, None]
                v.update(seen, np.stack([np.bincount(at, others[:, f], len(seen)) for f in range(rank)], axis=1))
            square += g.sum() ** 2
            bias -= STEP * g.sum() / np.sqrt(square)
    m = Machine(buckets, float(bias), w.value, v.value)
    a, b = calibration(np.concatenate([m.logits(ids[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in ((i, min(i + BATCH, n)) for i in range(0, n, BATCH))]), y)
    used = np.flatnonzero((w.value != 0) | (v.value != 0).any(axis=1))
    return Machine(buckets[used], a * float(bias) + b, a * w.value[used], np.sqrt(a) * v.value[used])


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``a`` (0 or more) and ``b`` for which ``a * z + b`` is the logit of the label (Platt 1999), by Newton's method with halved steps.

    Rows of label 1 count by the root of their rarity, halfway between as often as they occur and as often as the others. Logits that
    say nothing, as those of a model from a few labels, thus become one below zero if label 1 is rare.
    """
    n1 = float(y.sum())
    n0 = len(y) - n1
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    c = np.where(y > 0, np.sqrt(n0 / n1), 1.0)
    x = np.stack([z, np.ones_like(z)], axis=1)
    loss = lambda p: float((c * (np.logaddexp(0, x @ p) - t * (x @ p))).sum() + 1e-3 * p[0] ** 2)
    share = (c * t).sum() / c.sum()
    p = np.array([0.0, np.log(share / (1 - share))])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        grad = x.T @ (c * (q - t)) + [2e-3 * p[0], 0]
        step = np.linalg.solve((x * (c * q * (1 - q))[:, None]).T @ x + np.diag([2e-3, 1e-9]), grad)
        size = 1.0
        while size > 1e-6 and loss(p - size * step) > loss(p):
            size /= 2
        p = p - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(p[0]), float(p[1])) if p[0] > 0 else (0.0, float(np.log(share / (1 - share))))


def _present(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text and their bounds."""
    h, bounds = terms(buf, offsets, BITS)
    key = np.unique((np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) << BITS) | h)
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(len(offsets)))


def _known(buf: np.ndarray, offsets: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text that the machine knows and their bounds; ``slot`` has the number of each bucket, or -1."""
    h, bounds = terms(buf, offsets, BITS)
    hit = np.flatnonzero(slot[h] >= 0)
    key = np.unique(((np.searchsorted(bounds, hit, side="right") - 1) << 32) | slot[h[hit]].astype(np.int64))
    return key & 0xFFFFFFFF, np.searchsorted(key >> 32, np.arange(len(offsets)))


def _slots(buckets: np.ndarray) -> np.ndarray:
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    slot[buckets] = np.arange(len(buckets))
    return slot


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, where: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK) -> Machine:
    """Fit on at most ``rows`` labelled documents, of the labels that fulfil ``where`` (over ``id`` and ``y``)."""
    sample = labelled(docs, labels, label, rows, where, id_col, text_col)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts_of(batch.column(0))
            for i, j in pieces(offsets):
                h, bounds = _present(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.astype(np.int32)))], ["y", "h"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, found, counts = [np.zeros(0)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for batch in batches:
            y.append(np.clip(batch.column(0).to_numpy(zero_copy_only=False), 0, 1).astype(float))
            found.append(batch.column(1).flatten().to_numpy())
            counts.append(batch.column(1).value_lengths().to_numpy())
        buckets, ids = np.unique(np.concatenate(found), return_inverse=True)
        m = fit(buckets.astype(np.int64), ids, np.concatenate(([0], np.cumsum(np.concatenate(counts)))), np.concatenate(y), rank)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.buckets, np.array([m.bias]), m.weights, m.factors)], ["buckets", "bias", "weights", "factors"])
        trim()

    # one task, of at most ``rows`` rows in an order that only depends on them
    ordered = sample.mapInArrow(terms_of, "y int, h array<int>").withColumn("o", F.xxhash64("h", "y")).repartition(1).sortWithinPartitions("o", "y", F.col("h").cast("string"))
    r = ordered.select("y", "h").mapInArrow(learn, "buckets binary, bias binary, weights binary, factors binary").first()
    if r is None:  # no partition at all
        return fit(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0), rank)
    buckets = np.frombuffer(r.buckets, dtype=np.int64)
    return Machine(buckets, float(np.frombuffer(r.bias)[0]), np.frombuffer(r.weights), np.frombuffer(r.factors).reshape(len(buckets), rank))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, score`` of every row; null and empty texts have the score of a text without known terms."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _slots(machine.buckets)
        for batch in batches:
            buf, offsets = texts_of(batch.column(1))
            for i, j in pieces(offsets):
                z = machine.logits(*_known(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], slot))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])
        trim()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def held_out(column: F.Column) -> F.Column:
    """True for ids whose rows are never learnt from: crc32 of the id as text, modulo 5, is 0. A null id is as an empty text."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK) -> DataFrame:
    """One row per row of ``docs``: ``<id>, held_out, score, predicted``, by a machine fitted on labels that aren't held out.

    Rows that repeat have equal scores. Without any label, or with one class
    only, all scores are equal. An empty table gives an empty result. Other columns are never read.
    With ``rank`` 0 the model is linear.
    """
    machine = train(docs, labels, where=~held_out(F.col("id")), id_col=id_col, text_col=text_col, rank=rank)
    out = score(docs, machine, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all their columns; each row is judged by its own text."""
    machine = train(docs, labels, where=~held_out(F.col("id")), id_col=id_col, text_col=text_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _slots(machine.buckets)
        for batch in batches:
            buf, offsets = texts_of(batch.column(len(names)))
            keep = [np.zeros(0, dtype=bool)]
            for i, j in pieces(offsets):
                keep.append(machine.logits(*_known(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], slot)) < 0)
            yield batch.filter(pa.array(np.concatenate(keep))).select(list(range(len(names))))
        trim()

    return docs.select("*", F.col(text_col).cast("string").alias("__judged")).mapInArrow(run, docs.schema)
