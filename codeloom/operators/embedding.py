"""Embedding with reuse: stage nodes, take vectors known for equal content, embed the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import prompt
from .vectors import first_vectors


def nodes_to_embed(nodes: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Nodes without a vector of ``model``."""
    return nodes.join(embedded.filter(F.col("model_name") == model).select(F.col("chunk_id").alias("node_id")), "node_id", "left_anti")


def incoming_symbols(edges: DataFrame) -> DataFrame:
    """``node_id, symbols``: the sorted distinct symbols under which each node is called."""
    called = edges.filter((F.col("relation_type") == "calls") & F.col("symbol").isNotNull())
    return called.groupBy(F.col("target_id").alias("node_id")).agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def stage(nodes: DataFrame, edges: DataFrame, model: str) -> DataFrame:
    """The nodes with their prompt and its hash: one plan, no Python."""
    symbols = nodes.join(incoming_symbols(edges), "node_id", "left")
    text = prompt(F.col("file_path"), F.col("language"), F.col("category"), F.col("matches"), F.col("symbols"), F.col("content"))
    return symbols.withColumn("prompt", text).withColumn("vector_hash", F.sha2("prompt", 256)).withColumn("model_name", F.lit(model))


def backfill(staged: DataFrame, history: DataFrame, same_model: bool = True) -> DataFrame:
    """``staged`` with ``embedding`` from the history of equal content, null where there is none.

    Vectors of another model are only taken with ``same_model`` off.
    """
    if same_model:
        history = history.join(staged.select("model_name").distinct(), "model_name", "left_semi")
    known = first_vectors(history.join(staged.select("vector_hash").distinct(), "vector_hash", "left_semi"))
    return staged.join(known, "vector_hash", "left")


def split_hits(filled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a vector, which are stored, and those that are left to embed."""
    return filled.filter("embedding is not null"), filled.filter("embedding is null")


def embed(missing: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """``missing`` with ``embedding`` from ``provider``, once for each distinct prompt, in batches inside the tasks, and ``error``.

    A batch that fails leaves its rows without a vector and with what was wrong; the others go on.
    """
    once = missing.select("vector_hash", "prompt").dropDuplicates(["vector_hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                vectors: list = [None] * len(part)
                error = None
                try:
                    vectors = [np.asarray(v, dtype=np.float32) for v in provider(part.prompt.tolist())]
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                except Exception as e:  # noqa: BLE001 - one bad batch must not end the others
                    vectors, error = [None] * len(part), f"{type(e).__name__}: {e}"[:500]
                yield pd.DataFrame({"vector_hash": part.vector_hash, "embedding": pd.Series(vectors, index=part.index, dtype=object), "error": pd.Series([error] * len(part), index=part.index, dtype=object)})

    made = once.mapInPandas(run, "vector_hash string, embedding array<float>, error string")
    return missing.drop("embedding").join(made, "vector_hash")
