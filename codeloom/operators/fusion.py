"""Reciprocal rank fusion of ranked lists (Cormack et al. 2009)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def ranked(hits: DataFrame, method: str, id_col: str = "id", score: str = "score") -> DataFrame:
    """A search's hits (a bounded list) with their 0-based rank: ``id, method, rank``."""
    return hits.select(F.col(id_col).alias("id"), F.lit(method).alias("method"), (F.row_number().over(Window.orderBy(F.desc(score), id_col)) - 1).alias("rank"))


def fuse(lists: list[DataFrame], limit: int, k: int = K) -> DataFrame:
    """``id, score, methods`` of the best ids of all lists, which have ``id, method, rank``.

    An id scores the sum of ``1 / (k + rank + 1)``. Ties go by the rank in the list named
    ``vector``, then by that in ``keyword``, then by id. ``methods`` are joined by ``+``.
    """
    pool = reduce(DataFrame.unionByName, lists)
    place = lambda m: F.min(F.when(F.col("method") == m, F.col("rank"))).alias(f"__{m}")
    fused = pool.groupBy("id").agg(F.round(F.sum(1.0 / (F.col("rank") + (k + 1))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"), place("vector"), place("keyword"))
    return fused.orderBy(F.desc("score"), F.asc_nulls_last("__vector"), F.asc_nulls_last("__keyword"), "id").limit(limit).select("id", "score", "methods")
