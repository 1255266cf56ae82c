"""Write semantics of keyed tables, as plans over the old rows and the new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` to append: one for each key that ``old`` doesn't have (the first by all columns)."""
    order = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys)
    first = new.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return first.join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], refresh: list[str]) -> DataFrame:
    """``old`` with the columns ``refresh`` taken from ``new`` where the key exists, and the other rows of ``new``; keys are unique on both sides."""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.struct(*cols).alias("__new"))
    o = old.select(*keys, F.struct(*cols).alias("__old"))
    both = o.join(n, keys, "full_outer")
    pick = lambda c: F.when(F.col("__new").isNotNull() & (F.col("__old").isNull() | F.lit(c in refresh)), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in cols]).select(*old.columns)


def replace_latest(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last row written for each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("__r")).select(*keys, "__r.*")


def delete_cascade(snapshots: DataFrame, tables: dict[str, DataFrame], key: str = "snapshot_id") -> dict[str, DataFrame]:
    """Each table without the rows of the given snapshots, whose ids are column ``key``."""
    return {name: t.join(snapshots.select(key), key, "left_anti") for name, t in tables.items()}


def unreferenced(contents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Contents that no node refers to any more."""
    return contents.join(nodes.select("chunk_hash").distinct(), "chunk_hash", "left_anti")
