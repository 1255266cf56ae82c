"""Hashed terms of texts, and the labelled samples that models are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textnum import BYTE_VALUE, LOWER, U, mix64, powers, spans, span_hash

#: Bytes of letters: A-Z, a-z and all of other scripts.
IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def grams(buf: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of all runs of ``n`` bytes by text, and their bounds; a shorter text has none."""
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(count)))
    if not bounds[-1]:
        return np.zeros(0, dtype=np.int64), bounds
    pos, neg = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(BYTE_VALUE[buf] * pos[: len(buf)], out=total[1:])
    h = (mix64((total[n:] - total[:-n]) * neg[: len(buf) - n + 1]) >> U(64 - bits)).astype(np.int64)
    if len(count) > 1:
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(h)]
        h = h[np.arange(len(h)) + n <= ends]
    return h, bounds


def terms(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the words of texts (runs of letters, A-Z in lower case), repeats included, and their bounds."""
    low = LOWER[buf]
    starts, ends = spans(IS_LETTER[low], offsets)
    return (span_hash(BYTE_VALUE[low], starts, ends) >> U(64 - bits)).astype(np.int64), np.searchsorted(starts, offsets).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written sample ``t, y``: the documents of at most ``rows`` labelled ids, chosen by hash.

    An id with several labels counts with the highest, an id with several texts with the one whose
    SHA-256 is smallest, so that the sample is the same whatever the partitions. Labels that are null, or
    whose id is null, don't count.
    """
    one = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null")
    if where is not None:
        one = one.filter(where)
    one = one.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(one), "id")
    once = sample.groupBy("id", "y").agg(F.min_by("t", F.sha2(F.coalesce("t", F.lit("")), 256)).alias("t"))
    return written(once.select("t", "y"), "sample")
