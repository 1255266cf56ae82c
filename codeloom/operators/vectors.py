"""Exact nearest neighbours by cosine similarity, and vectors kept by content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine


def knn(vectors: DataFrame, query: Sequence[float], k: int, where: Column | None = None, id_col: str = "id", vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The ``k`` rows most similar to ``query``: ``<id>, <keep>, score``, ties by id.

    Rows of another dimension, null vectors and vectors without length are no
    candidates; a query without length finds nothing. Filters come before the
    scores, and each task keeps only its own ``k``.
    """
    rows = vectors if where is None else vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.filter(F.size(vector) == len(query)).select(id_col, *(keep or []), F.round(cosine(F.col(vector), q), 6).alias("score")).filter("score is not null")
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", block: int = 8192) -> DataFrame:
    """``query_id, rank, id, score`` for each query, without the query's own row, by one matrix product per batch.

    Queries go to the vectors in blocks of about ``block``, and each task keeps ``k`` rows for each. Null vectors,
    those of another dimension than the first query's and those without length are no candidates and ask for nothing.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    asked = queries.select(F.col(id_col).alias("q"), F.col(vector).alias("v")).filter("v is not null")
    n = asked.count()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    dim = len(asked.orderBy("q").select("v").first().v)
    asked = asked.filter(F.size("v") == dim)
    blocks = -(-n // block)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).filter(F.size("v") == dim)
    found = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()  # about ``block`` rows
        if not len(part):
            continue
        names = part.q.to_numpy()
        q = np.stack(part.v.to_list()).astype(np.float64)
        length = np.linalg.norm(q, axis=1, keepdims=True)
        names, q = names[length[:, 0] > 0], (q / np.maximum(length, 1e-300))[length[:, 0] > 0]
        sent = spark.sparkContext.broadcast((names, q))

        def run(batches: Iterator[pd.DataFrame], sent: object = sent) -> Iterator[pd.DataFrame]:
            names, q = sent.value
            for pdf in batches:
                if not len(pdf) or not len(names):
                    continue
                x = np.stack(pdf.v.to_list()).astype(np.float64)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                ids = pdf.id.to_numpy()
                s = np.round(q @ (x / np.maximum(size, 1e-300)).T, 6)
                s[:, size[:, 0] == 0] = -np.inf
                s[names[:, None] == ids[None, :]] = -np.inf
                out: list[list] = [[], [], []]
                for i in range(len(q)):
                    cut = np.partition(s[i], len(ids) - k)[len(ids) - k] if len(ids) > k else -np.inf
                    near = np.flatnonzero((s[i] >= cut) & np.isfinite(s[i]))
                    top = near[np.lexsort((ids[near], -s[i][near]))[:k]]
                    out[0].append(np.full(len(top), names[i]))
                    out[1].append(ids[top])
                    out[2].append(s[i][top])
                yield pd.DataFrame({"query_id": np.concatenate(out[0]), "id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

        made = rows.mapInPandas(run, f"query_id {kind}, id {kind}, score double")
        found = made if found is None else found.unionByName(made)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def first_vectors(vectors: DataFrame, hash_col: str = "vector_hash", order: str = "id", vector: str = "embedding") -> DataFrame:
    """One vector for each content hash: that of the smallest ``order``."""
    return vectors.filter(F.col(vector).isNotNull()).groupBy(hash_col).agg(F.min_by(vector, order).alias(vector))


def seeded_vector(text: Column, dim: int) -> Column:
    """A stand-in embedding that only depends on the text: hashed components from -1 to 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64(text, i), F.lit(2001)) - 1000).cast("float") / F.lit(1000).cast("float"))


def seeded(text: str, dim: int) -> list[float]:
    """The same for one text on a provider's side: components from -1 to 1 that only depend on the text."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    return np.random.default_rng(seed).uniform(-1, 1, dim).astype(np.float32).tolist()
