"""Sharding by vector bin packing over bytes, tokens and rows.

Rows with equal texts form a group, which one shard takes whole unless the
group alone is larger than half a shard. The largest group goes first, each to the shard where the
dot product of its vector with the residual capacity is highest.

Heavy groups (more than 1/``HEAVY`` of a total; there can be no more than ``3 * HEAVY``) are placed on the driver. The lighter ones
are dealt to cells of about ``CELL_GROUPS`` groups by hash; a task places each group of its cell by the same rule, into the
cell's part of what the heavy ones leave free in each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .tokens import encoder

HEAVY = 2048
CELL_GROUPS = 1 << 15
UNIT_ROWS = 1 << 20
CHUNK = 300_000
WORD = r"[^\x20\x09-\x0D]+"
VECTOR = ["size", "n_tokens", "n"]


def place(items: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The shard of each item; ``items`` has a row of (bytes, tokens, rows) each, ``capacity`` one for each shard.

    Where no shard has room in every dimension the dot product alone decides, which is
    highest where the room is, so that overflow evens out. Ties go to the lower shard.
    """
    unit = np.maximum(capacity.mean(axis=0), 1e-9)
    vec = items / unit
    residual = capacity / unit
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -vec[:, 0], -vec.max(axis=1))):
        v = vec[i]
        score = residual @ v
        fits = (residual >= v).all(axis=1)
        if fits.any():
            score = np.where(fits, score, -np.inf)
        s = int(score.argmax())
        out[i] = s
        residual[s] -= v
    return out


def _token_counts(rows: DataFrame, vocabulary: str) -> DataFrame:
    """``rows`` with ``n_tokens`` in the place of the text ``t``, their last column."""
    names = rows.columns[:-1]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            counts = [np.zeros(0, dtype=np.int64)]
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK)))
                counts.append(np.diff(encode(texts[a:b])[1]))
                a = b
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(np.concatenate(counts), pa.int64())], [*names, "n_tokens"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_tokens long")


def shard(docs: DataFrame, shards: int = 24, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id>, size, text_crc32, law, shard, slot, grown_shard, n_tokens``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8, ``n_tokens`` its tokens by the tokenizer in the file ``vocabulary``, or its words without one.
    Shards have nearly equal sums of ``size`` (law ``bytes``), tokens and rows. ``slot`` numbers the
    rows of a shard from 0 without gaps. Null and empty texts are
    one group. Rows that repeat are placed each; rows with a null id likewise. With fewer rows
    than shards some shards stay empty; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    about = [F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("g")]
    counted = _token_counts(docs.select(*about, text.alias("t")), vocabulary) if vocabulary else docs.select(*about, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))
    rows = written(counted.withColumn("u", F.monotonically_increasing_id()), "sizes").withColumn("n", F.lit(1).cast("long"))
    groups = written(rows.groupBy("g").agg(*[F.sum(c).alias(c) for c in VECTOR]), "groups")
    sums = lambda df: np.array([x or 0 for x in df.agg(*[F.sum(c) for c in VECTOR]).first()], dtype=float)
    total = sums(groups)
    limit = np.maximum(total / HEAVY, 1)
    heavy_if = (F.col("size") > float(limit[0])) | (F.col("n_tokens") > float(limit[1])) | (F.col("n") > float(limit[2]))
    heavy = sorted(groups.filter(heavy_if).collect(), key=lambda r: r.g)
    parts = {}  # a group larger than half a shard: its number of parts
    for r in heavy:
        share = max(a / max(b, 1) for a, b in zip((r[c] for c in VECTOR), total)) * shards
        if share > 0.5 and r.n > 1:
            parts[r.g] = min(int(np.ceil(share * 16)), r.n)
    part = F.pmod(F.xxhash64(F.col("id"), F.when(F.col("id").isNull(), F.col("u")), F.lit(7)), F.col("parts"))
    split = spark.createDataFrame(list(parts.items()), "g long, parts long")
    got = {(r.g, r.p): [r[c] for c in VECTOR] for r in rows.join(F.broadcast(split), "g").groupBy("g", part.alias("p")).agg(*[F.sum(c).alias(c) for c in VECTOR]).collect()} if parts else {}
    items = [(r.g, p, got.get((r.g, p), [0, 0, 0]) if r.g in parts else [r[c] for c in VECTOR]) for r in heavy for p in range(parts.get(r.g, 1))]
    capacity = np.repeat(total[None, :] / shards, shards, axis=0)
    vectors = np.array([v for *_, v in items], dtype=float).reshape(-1, 3)
    where = place(vectors, capacity)
    for s, v in zip(where, vectors):
        capacity[s] -= v
    free = np.maximum(capacity, 0)
    heavy_map = spark.createDataFrame([(g, parts.get(g, 1), p, int(s)) for (g, p, _), s in zip(items, where)], "g long, parts long, part long, shard int")

    light = groups.filter(~heavy_if)
    cells = max(1, -(-light.count() // CELL_GROUPS))
    share = free / np.maximum(free.sum(axis=0), 1e-9)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", ignore_index=True)
        own = pdf[VECTOR].to_numpy(dtype=float)
        return pd.DataFrame({"g": pdf.g, "shard": place(own, share * own.sum(axis=0)).astype(np.int32)})

    dealt = written(light.withColumn("cell", F.pmod(F.xxhash64("g"), F.lit(cells))).groupBy("cell").applyInPandas(deal, "g long, shard int"), "dealt")
    big = F.broadcast(heavy_map.select("g", "parts").distinct())  # no more than 3 * HEAVY groups, and heavy_map no more than their parts
    own = ["id", "size", "text_crc32", "n_tokens", "u"]
    placed = rows.join(big, "g").withColumn("part", part).join(F.broadcast(heavy_map.select("g", "part", "shard")), ["g", "part"]).select(*own, "shard")
    placed = placed.unionByName(rows.join(big, "g", "left_anti").join(dealt, "g").select(*own, "shard"))
    # slots: a shard's rows in units by hash, which are numbered each
    units = max(1, int(-(-total[2] // UNIT_ROWS)))
    placed = written(placed.withColumn("unit", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("u")), F.lit(11)), F.lit(units))), "placed")
    before = Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "unit").agg(F.count(F.lit(1)).alias("c")).select("shard", "unit", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "unit").orderBy("id", "text_crc32")
    return placed.withColumn("at", F.row_number().over(inside) - 1).join(base, ["shard", "unit"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens",
    )
