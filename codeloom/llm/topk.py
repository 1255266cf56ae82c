"""Exact top-k by inner product with a bit-sliced index.

The index holds rows in blocks of at most ``BLOCK``. Of each attribute (a component of the
integer vectors) it stores the ``SLICES`` highest bits as bitmaps over the block's
rows, beside the integers. A query's weights are rounded to ``WEIGHT_BITS`` bits; the rounded sum of all
rows comes from shifted additions of slices with bitmap arithmetic, for some queries at once. From the most
significant slice of the sum downward, bitmaps then select the ``k`` highest
rows; what the rounding can change at most widens that to the boundary rows, whose
scores are computed from the integers themselves. Thus the result is exact.

The index is written once and its blocks stay where they are: queries are sent to them in chunks of ``CHUNK_BYTES``, and a
task returns ``k`` rows for each block and query, of which a window keeps the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch_path, written

SCALE = 1024
BLOCK = 1 << 16
QUERY_BLOCK = 1 << 12
#: Queries are broadcast in chunks of so many bytes at most (but one block of queries at least).
CHUNK_BYTES = 1 << 25
SLICES = 7
WEIGHT_BITS = 7
#: Queries are added up together as long as their bitmaps have about so many 64-bit words.
TOGETHER = 4096
INDEX = "block long, ids binary, wide boolean, vectors binary, low binary, shift int, slices binary, error double, norm double"


def quantised(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(SCALE * x)`` of each usable vector, padded with zeros to ``dim``, and the usable rows' numbers."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = len(lists)
    offsets = lists.offsets.to_numpy()
    values = lists.values
    nulls = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else np.zeros(len(values), dtype=bool)
    x = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(nulls | ~np.isfinite(x))))
    size = np.diff(offsets)
    ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~lists.is_null().to_numpy(zero_copy_only=False) if n else np.zeros(0, dtype=bool)
    rows = np.flatnonzero(ok)
    out = np.zeros((len(rows), dim), dtype=np.int64)
    r = np.repeat(np.arange(len(rows)), size[rows])
    c = np.arange(len(r)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
    whole = np.floor(SCALE * x[offsets[:-1][rows][r] + c])
    if len(r) and np.abs(whole).max() >= 2.0**62:
        raise OverflowError("components of 2^52 and more have no 64-bit inner products")
    out[r, c] = whole.astype(np.int64) if len(r) else 0
    return out, rows


def pack(bits: np.ndarray) -> np.ndarray:
    """A bitmap of 64-bit words of booleans, whose number is a multiple of 64."""
    return np.packbits(bits, bitorder="little").view(np.uint64)


def plain(vectors: np.ndarray) -> tuple[bool, bytes]:
    """Whether the vectors need 64 bits a component, and their bytes."""
    wide = bool(vectors.size and np.abs(vectors).max() >= 1 << 31)
    return wide, vectors.astype("<i8" if wide else "<i4").tobytes()


def integers(wide: bool, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8" if wide else "<i4").astype(np.int64).reshape(n, -1 if n else 0)


class BitSlicedBlock:
    """The index of one block: ids and integer vectors, and the bit slices of each attribute."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, stored: dict | None = None):
        self.ids, self.vectors = ids, vectors
        n, dim = vectors.shape
        self.words = -(-n // 64)
        if stored is None:
            self.low = vectors.min(axis=0)
            spread = int((vectors.max(axis=0) - self.low).max()) if dim else 0
            self.shift = max(0, spread.bit_length() - SLICES)
            u = (vectors - self.low) >> self.shift
            padded = np.zeros((self.words * 64, dim), dtype=np.int64)
            padded[:n] = u
            self.slices = np.array([[pack((padded[:, d] >> b) & 1) for b in range(SLICES)] for d in range(dim)], dtype=np.uint64).reshape(dim, SLICES, self.words)
            # an attribute is low + (u << shift) + middle + e, where e is at most half a step
            error = vectors - self.low - (u << self.shift) - ((1 << self.shift) - 1) / 2
            self.error = float(np.sqrt((error**2).sum(axis=1).max()))
            self.norm = float(np.sqrt((vectors.astype(float) ** 2).sum(axis=1).max()))
        else:
            self.low = np.frombuffer(stored["low"], dtype="<i8")
            self.slices = np.frombuffer(stored["slices"], dtype="<u8").reshape(dim, SLICES, self.words)
            self.shift, self.error, self.norm = stored["shift"], stored["error"], stored["norm"]
        live = np.zeros(self.words * 64, dtype=bool)
        live[:n] = True
        self.live = pack(live)
        self.order = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.order]

    def row(self, block: int) -> pa.RecordBatch:
        """The block as a row of the stored index."""
        wide, data = plain(self.vectors)
        values = [block, self.ids.astype("<i8").tobytes(), wide, data, self.low.astype("<i8").tobytes(), self.shift, self.slices.astype("<u8").tobytes(), self.error, self.norm]
        kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in INDEX.split(", ")])

    def rounded(self, weights: np.ndarray) -> list[np.ndarray]:
        """For each query, slices, lowest first, of the sum of ``|w| * u``, with ``u`` counted down where ``w`` is negative."""
        total: list[np.ndarray] = []
        size, down = np.abs(weights), weights < 0
        for j in range(WEIGHT_BITS):
            for d in range(weights.shape[1]):
                rows = np.flatnonzero((size[:, d] >> j) & 1)
                if len(rows):
                    flip = np.where(down[rows, d], ~np.uint64(0), np.uint64(0))[:, None]
                    self._add(total, j, d, rows, flip, len(weights))
        return total

    def _add(self, total: list[np.ndarray], at: int, d: int, rows: np.ndarray, flip: np.ndarray, n: int) -> None:
        every = len(rows) == n
        carry = None
        b = 0
        while b < SLICES or carry is not None:
            while len(total) <= at + b:
                total.append(np.zeros((n, self.words), dtype=np.uint64))
            t = total[at + b] if every else total[at + b][rows]
            if b < SLICES:
                x = self.slices[d, b] ^ flip
                half = t ^ x
                both = t & x
                new, carry = (half, both) if carry is None else (half ^ carry, both | (half & carry))
            else:
                new, carry = t ^ carry, t & carry
                if not carry.any():
                    carry = None
            if every:
                total[at + b] = new
            else:
                total[at + b][rows] = new
            b += 1

    def others(self, query_ids: np.ndarray) -> np.ndarray:
        """For each query the bitmap of the rows with another id, however often the query's own is repeated."""
        out = np.repeat(self.live[None, :], len(query_ids), axis=0)
        low, high = (np.searchsorted(self.sorted_ids, query_ids, side) for side in ("left", "right"))
        for q in np.flatnonzero(high > low).tolist():
            own = self.order[low[q] : high[q]]
            np.bitwise_and.at(out[q], own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
        return out

    def kth(self, total: list[np.ndarray], k: int, live: np.ndarray) -> list[int]:
        """Each query's ``k``-th highest rounded sum of the rows in ``live``, read from the most significant slice downward."""
        sure = np.zeros_like(live)
        open_ = live.copy()
        values = [0] * len(live)
        for b in range(len(total) - 1, -1, -1):
            high = open_ & total[b]
            enough = np.bitwise_count(sure | high).sum(axis=1) >= k
            sure = np.where(enough[:, None], sure, sure | high)
            open_ = np.where(enough[:, None], high, open_ & ~total[b])
            for q in np.flatnonzero(enough).tolist():
                values[q] |= 1 << b
        return values

    def at_least(self, total: list[np.ndarray], value: int, q: int, live: np.ndarray) -> np.ndarray:
        """The rows in ``live`` whose rounded sum for query ``q`` is ``value`` or more."""
        above = np.zeros(self.words, dtype=np.uint64)
        equal = live.copy()
        if value <= 0:
            above = equal
        elif value >> len(total) == 0:
            for b in range(len(total) - 1, -1, -1):
                if value >> b & 1:
                    equal &= total[b][q]
                else:
                    above |= equal & total[b][q]
                    equal &= ~total[b][q]
            above |= equal
        return np.flatnonzero(np.unpackbits(above.view(np.uint8), bitorder="little"))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions in the block of the ``k`` highest scores (ties to smaller ids), without the query's own rows, and the scores."""
        out = []
        step = max(1, TOGETHER // max(self.words, 1))
        for a in range(0, len(queries), step):
            v = queries[a : a + step]
            if v.size and np.sqrt((v.astype(float) ** 2).sum(axis=1)).max() * self.norm >= 2.0**63:
                raise OverflowError("an inner product may exceed 64 bits")
            most = np.abs(v).max(axis=1) if v.shape[1] else np.zeros(len(v))
            unit = np.where(most > 0, most / ((1 << WEIGHT_BITS) - 1), 1.0)
            w = np.rint(v / unit[:, None]).astype(np.int64)
            total = self.rounded(w)
            # score = unit * step * sum + a constant of the query, up to these bounds
            slack = unit * np.sqrt((w.astype(float) ** 2).sum(axis=1)) * self.error + np.sqrt(((v - unit[:, None] * w) ** 2).sum(axis=1)) * self.norm
            room = (2 * slack / (unit * float(1 << self.shift))).astype(np.int64) + 2
            live = self.others(query_ids[a : a + step])
            for q, value in enumerate(self.kth(total, k, live)):
                rows = self.at_least(total, value - int(room[q]), q, live[q])
                scores = self.vectors[rows] @ v[q]
                if len(rows) > k:
                    near = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
                    rows, scores = rows[near], scores[near]
                order = np.lexsort((self.ids[rows], -scores))[:k]
                out.append((rows[order], scores[order]))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, size: int, sliced: bool) -> Iterator[pa.RecordBatch]:
    """The usable rows of a partition in blocks: rows of the stored index, or ``block, n, ids, wide, vectors``."""
    part = TaskContext.get().partitionId()
    ids: list[np.ndarray] = []
    vectors: list[np.ndarray] = []
    have = made = 0

    def flush() -> pa.RecordBatch:
        nonlocal made
        i, v = np.concatenate(ids), np.concatenate(vectors)
        made += 1
        name = (part << 32) | (made - 1)
        if sliced:
            return BitSlicedBlock(i, v).row(name)
        wide, data = plain(v)
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([len(i)], pa.int32()), pa.array([i.astype("<i8").tobytes()], pa.binary()), pa.array([wide]), pa.array([data], pa.binary())], ["block", "n", "ids", "wide", "vectors"])

    for batch in batches:
        v, rows = quantised(batch.column(1), dim)
        own = batch.column(0).cast(pa.int64()).take(pa.array(rows)).to_numpy(zero_copy_only=False)
        for a in range(0, len(rows), size):
            take = slice(a, a + size)
            if have + len(own[take]) > size and have:
                yield flush()
                ids, vectors, have = [], [], 0
            ids.append(own[take])
            vectors.append(v[take])
            have += len(own[take])
    if have:
        yield flush()


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products, ties to smaller ids.

    Components become ``floor(1024 * x)``, with x as double. A row's own id is no candidate of
    it. Vectors that are null, or hold null or non-finite components, take no part, neither do rows with a null
    id. Shorter vectors count as padded with zeros; vectors whose inner products may not fit in 64 bits raise ``OverflowError``.
    Rows that repeat are separate candidates; a query id that repeats with
    several vectors has the best rows of all its vectors. Without queries or
    candidates the result is empty.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).filter("id is not null and x is not null")
    dim = pick(vectors).agg(F.max(F.size("x"))).first()[0] or 0
    dim = max(dim, pick(queries).agg(F.max(F.size("x"))).first()[0] or 0)
    index = written(pick(vectors).mapInArrow(lambda it: _blocks(it, dim, block, True), INDEX), "index")
    asked = written(pick(queries).mapInArrow(lambda it: _blocks(it, dim, query_block, False), "block long, n int, ids binary, wide boolean, vectors binary"), "queries")
    chunks: list[list[int]] = []
    size = chunk_bytes
    for r in asked.select("block", "n").sort("block").collect():  # one for each block of queries
        if size + r.n * 8 * (dim + 1) > chunk_bytes:
            chunks.append([])
            size = 0
        chunks[-1].append(r.block)
        size += r.n * 8 * (dim + 1)

    # the stated queries against all rows, in blocks: each chunk of queries goes to the index blocks, which are not moved
    path = scratch_path(spark, "found")
    for own in chunks:
        parts = asked.filter(F.col("block").isin(own)).sort("block").collect()
        sent = spark.sparkContext.broadcast((
            np.concatenate([np.frombuffer(r.ids, dtype="<i8") for r in parts]), np.concatenate([integers(r.wide, r.vectors, r.n).reshape(r.n, dim) for r in parts]),
        ))

        def search(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            names, asked_for = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    ids = np.frombuffer(r["ids"], dtype="<i8")
                    one = BitSlicedBlock(ids, integers(r["wide"], r["vectors"], len(ids)).reshape(len(ids), dim), r)
                    found = one.search(names, asked_for, k)
                    count = np.array([len(rows) for rows, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, count)), pa.array(one.ids[np.concatenate([rows for rows, _ in found])]), pa.array(np.concatenate([x for _, x in found]).astype(np.int64))], ["query_id", "vec_id", "score"])

        index.mapInArrow(search, "query_id long, vec_id long, score long").write.mode("append").parquet(path)
        sent.destroy()
    if not chunks:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score")
