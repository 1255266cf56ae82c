"""Removal of repeated byte strings by distributed prefix doubling over named positions.

A position is removed if the ``threshold`` bytes behind it also start earlier. Ranks of the bytes behind a
position come from pairs of ranks of their parts; a round gives equal pairs one rank, and a position leaves as soon as its
rank is unique, or is known to repeat.

1. Every window of ``threshold`` bytes names one position in it, the one with the
   smallest hash of ``SEED`` bytes (leftmost first). Equal windows name the same one, so
   only named positions, some 3 % of all, are ranked at first, by their ``SEED`` bytes. A run of
   windows that name one position is a unit. Units with a unique rank leave.
2. The units that are left are compared as a whole. All windows of a unit
   that also starts earlier repeat. What is left of a rank of round 1 with only
   one kind of unit is unique and leaves.
3. Windows of the units that are left form groups of up to ``GROUP`` at fixed distances from their named position.
   Two positions of a group, the start of what its windows share and the one from which half of it reaches the end, are ranked
   by twice the bytes: Spark sorts the pairs of names of both halves, and each pair that occurs again has its place in that order for a rank.
   A group of which a position is unique leaves.
4. The pair of both positions' ranks, whose bytes overlap, ranks all that the group's windows share, with the outcomes of rounds 1 and 2.
5. Single windows of the groups that are left are ranked by that rank and by what they have besides; all
   but the first of each rank repeat.

The shuffles carry only what the round before left undecided. Every aggregate combines before its shuffle, the rows of hot
ranks aren't shuffled to be joined with them, and no group is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .shared import drop_scratch, join_counted, release, written
from .textnum import BYTE_VALUE, U, mix64, pieces, powers, texts_of

THRESHOLD = 100
SEED = 32
GROUP = 8
PIECE = 1 << 18
POSITION_BITS = 24
SEGMENT = 1 << 23
NULL_ID = -(1 << 63)


def prefix_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``gram`` needs of a buffer: sums of powers, and the inverse powers."""
    pos, neg = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(BYTE_VALUE[buf] * pos[: len(buf)], out=total[1:])
    return total, neg


def gram(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """The names of the spans from ``starts`` to ``ends``."""
    total, neg = sums
    return mix64((total[ends] - total[starts]) * neg[starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def units(buf: np.ndarray, offsets: np.ndarray, threshold: int, seed: int) -> tuple[np.ndarray, ...]:
    """``text, first window, number of windows, distance to the named position, its rank, rank of the unit`` of each unit."""
    n = len(buf)
    width = threshold - seed + 1
    if n < threshold:
        return tuple(np.zeros(0, dtype=d) for d in (np.int64, np.int64, np.int64, np.int64, U, U))
    sums = prefix_sums(buf)
    g = gram(sums, slice(0, n - seed + 1), slice(seed, n + 1))
    packed = (g >> U(POSITION_BITS)) << U(POSITION_BITS) | np.arange(len(g), dtype=U)
    named = (sliding_min(packed, width) & U((1 << POSITION_BITS) - 1)).astype(np.int64)  # of window s
    windows = np.maximum(np.diff(offsets) - threshold + 1, 0)
    text = np.repeat(np.arange(len(windows)), windows)
    s = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(offsets[:-1], windows)
    m = named[s]
    begin = np.ones(len(s), dtype=bool)
    begin[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(begin)
    count = np.diff(np.append(at, len(s)))
    s0 = s[at]
    unit = gram(sums, s0, s0 + count - 1 + threshold) + count.astype(U)
    return text[at], s0 - offsets[text[at]], count, m[at] - s0, g[m[at]], unit


def _segments(buf: np.ndarray, offsets: np.ndarray, threshold: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first text, start in it, bytes, offsets``: whole texts, or overlapping parts of one very long text."""
    for a, b in pieces(offsets, PIECE):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= SEGMENT + threshold:
            yield a, 0, buf[lo:hi], offsets[a : b + 1] - lo
            continue
        for c in range(a, b):
            lo, hi = int(offsets[c]), int(offsets[c + 1])
            for x in range(lo, max(lo + 1, hi - threshold + 1), SEGMENT):
                y = min(hi, x + SEGMENT + threshold - 1)
                yield c, x - lo, buf[x:y], np.array([0, y - x])


def _units(batches: Iterator[pa.RecordBatch], threshold: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = texts_of(batch.column(2))
        for a, begin, b, o in _segments(buf, offsets, threshold):
            text, s0, count, off, h, u = units(b, o, threshold, seed)
            if len(text):
                rows = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(s0 + begin), pa.array(count.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(u.view(np.int64))], ["doc", "v", "s0", "cnt", "off", "h", "u"])


def halves(threshold: int) -> tuple[int, int, int]:
    """Lengths of what a group's windows share, of the parts ranked in round 3, and of the names that these begin with."""
    core = threshold - GROUP + 1
    name = max(SEED, -(-core // 4))
    return core, min(2 * name, core), name


def _groups(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """The groups of windows of ``doc, v, t, r`` (a list of s0, cnt and off): names of the halves of two positions, of the whole, and of what each window has besides.

    Texts of about ``PIECE`` bytes are worked on at once.
    """
    core, part, name = halves(threshold)
    for batch in batches:
        buf, offsets = texts_of(batch.column(2))
        lists = batch.column(3)
        bounds = lists.offsets.to_numpy()
        fields = [lists.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
        for first, last in pieces(offsets, PIECE):
            s0, cnt, off = (x[bounds[first] : bounds[last]] for x in fields)
            row = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))
            base = offsets[row]
            low, high = int((base + s0).min()), int((base + s0 + cnt).max()) + threshold - 1
            sums = prefix_sums(buf[low:high])
            unit = np.repeat(np.arange(len(s0)), cnt)
            s = np.arange(len(unit)) + (s0 - np.cumsum(cnt) + cnt)[unit]
            j = ((s0 + off)[unit] - s) // GROUP
            begin = np.ones(len(s), dtype=bool)
            begin[1:] = (unit[1:] != unit[:-1]) | (j[1:] != j[:-1])
            at = np.flatnonzero(begin)
            bound = np.append(at, len(s))
            count = np.diff(bound)
            x = s + (base - low)[unit]
            p = (s0 + off + base - low)[unit] - GROUP * j  # of each window, where its group's shared bytes begin
            q = p[at] + core - part
            names = [gram(sums, y, y + name) for y in (p[at], p[at] + part - name, q, q + part - name)]
            names[0] = names[0] + j[at].astype(U)
            whole = gram(sums, x[at], x[at] + count - 1 + threshold) + count.astype(U)
            ends = mix64(gram(sums, x, p) * U(0x9E3779B97F4A7C15) + gram(sums, p + core, x + threshold) + (p - x).astype(U))
            own = row[unit[at]]
            k = len(at)
            for c in range(0, k, 100_000):
                d = min(k, c + 100_000)
                e = bound[c : d + 1]
                rest = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(ends[e[0] : e[-1]].view(np.int64)))
                rows = pa.array(own[c:d])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(s[at[c:d]]), pa.array(count[c:d].astype(np.int32)), *(pa.array(y[c:d].view(np.int64)) for y in (*names, whole)), rest],
                    ["doc", "v", "s0", "cnt", "a1", "a2", "b1", "b2", "u", "w"],
                )


def covered(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, end`` of the maximal runs of bytes that the spans cover, which never join two texts."""
    order = np.argsort(starts, kind="stable")
    text, starts, ends = text[order], starts[order], np.maximum.accumulate(ends[order])
    begin = np.ones(len(starts), dtype=bool)
    begin[1:] = (starts[1:] > ends[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(begin)
    return text[at], starts[at], ends[np.append(at[1:], len(ends)) - 1] if len(at) else ends


def _cut(batches: Iterator[pa.RecordBatch], threshold: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = texts_of(batch.column(1))
        lists = batch.column(2)
        bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        found = lists.flatten()
        s0, cnt = (found.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        for a, b in pieces(offsets, PIECE):
            lo, hi = int(offsets[a]), int(offsets[b])
            own = slice(bounds[a], bounds[b])
            text = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
            base = offsets[a:b] - lo
            starts = base[text] + s0[own]
            text, starts, ends = covered(text, starts, starts + cnt[own] - 1 + threshold)
            edge = np.zeros(hi - lo + 1, dtype=np.int8)
            edge[starts] += 1
            edge[ends] -= 1
            kept = buf[lo:hi][np.cumsum(edge[:-1], dtype=np.int8) == 0] if len(text) else buf[lo:hi]
            n = np.diff(offsets[a : b + 1])
            gone = np.bincount(text, ends - starts, minlength=b - a).astype(np.int64)
            to = np.concatenate(([0], np.cumsum(n - gone)))
            view = memoryview(np.ascontiguousarray(kept))
            cuts = [view[x:y] for x, y in zip(to[:-1].tolist(), to[1:].tolist())]
            runs = np.bincount(text, minlength=b - a).astype(np.int64)
            out = [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(gone), pa.array(runs), pa.array([hashlib.sha256(x).hexdigest() for x in cuts], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                both = np.stack([starts - base[text], ends - base[text]], axis=1).ravel()
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(2 * runs))).astype(np.int32)), pa.array(both))
                out += [pa.array([bytes(x) for x in cuts], pa.binary()), spans]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(out, names)


def _order(bounds: Row) -> Column:
    """Where a start comes in the order by id and position, as one number where the ids allow it."""
    low, high, most = bounds
    if low is not None and (high - low + 1) * (span := most + 1024) < 1 << 62:  # a run has far fewer windows
        return (F.col("doc") - F.lit(low)) * F.lit(span) + F.col("s0")
    return F.struct("doc", "s0")


def _round(table: DataFrame, keys: list[str], bounds: Row) -> DataFrame:
    """One round over runs of windows: those that are ``later``, and those not decided yet.

    ``keys`` rank the bytes that all windows of a run share, ``u`` all bytes of the run. A run with
    a unique rank is unique; one whose ``u`` starts earlier repeats; one whose rank goes
    with no other ``u`` is the first of its kind and has no other windows to meet.
    ``table`` is dropped.
    """
    spark = table.sparkSession
    again = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1")).filter("n > 1").select(*keys, "n", (F.col("u0") != F.col("u1")).alias("kinds"))
    again = written(again, "again")
    release(spark)
    undecided = written(join_counted(table, again, keys, table.count()), "undecided")
    drop_scratch(table)
    drop_scratch(again)
    release(spark)
    at = _order(bounds)
    ranked = written(undecided.groupBy("u").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    judged = join_counted(undecided, ranked, ["u"], undecided.count()).withColumn("later", at > F.col("first")).filter("later or kinds").drop("first", "kinds", "u")
    judged = written(judged, "judged")
    drop_scratch(undecided)
    drop_scratch(ranked)
    release(spark)
    return judged


def _doubled(groups: DataFrame) -> DataFrame:
    """``item, ra, rb`` of the groups both of whose positions occur again: the ranks of the pairs of names at each.

    The pairs that occur more than once are sorted; the place in that order is the rank.
    """
    side = lambda n, x, y: groups.select("item", F.lit(n).cast("byte").alias("side"), F.col(x).alias("k1"), F.col(y).alias("k2"))
    positions = side(0, "a1", "a2").unionByName(side(1, "b1", "b2"))
    pairs = positions.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").sort("k1", "k2")
    ranks = written(pairs.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    release(groups.sparkSession)
    ranked = join_counted(positions, ranks, ["k1", "k2"], 2 * groups.count()).select("item", "side", "rank")
    return ranked.groupBy("item").agg(F.max(F.when(F.col("side") == 0, F.col("rank"))).alias("ra"), F.max(F.when(F.col("side") == 1, F.col("rank"))).alias("rb")).filter("ra is not null and rb is not null")


def suffix_dedup(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_bytes, n_removed, n_spans, kept_sha256``; with ``with_text`` also ``kept`` (bytes) and ``spans`` (bounds of removed runs).

    Texts are their UTF-8 bytes, null is empty. Removed is each byte of a window of ``threshold``
    bytes that also starts earlier: in a row with a smaller id, or in the same
    row at a smaller position. Windows never cross rows. A null id counts as
    the smallest. Rows that repeat both id and text are one document and get
    the same result; of rows with one id and different texts the earlier start
    comes first. A text shorter than the threshold stays whole; an empty table gives an
    empty result. Ids must be integers; a ``threshold`` that isn't from 64 to 1000 raises ``ValueError``.
    """
    if not 64 <= threshold <= 1000:
        raise ValueError(f"the threshold must be from 64 to 1000, not {threshold}")
    spark = docs.sparkSession
    seed = SEED
    kind = dict(docs.dtypes)[id_col]
    ids = docs.select(F.col(id_col).alias("id"))
    repeated = not ids.groupBy("id").count().filter("count > 1").isEmpty()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    version = F.xxhash64(text) if repeated else F.lit(0).cast("long")  # tells rows with one id apart
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), version.alias("v"), text.alias("t"))

    table = written(base.select("doc", "v", "t").filter(F.octet_length("t") >= threshold).mapInArrow(lambda it: _units(it, threshold, seed), "doc long, v long, s0 long, cnt int, off int, h long, u long"), "units")
    bounds = table.agg(F.min("doc"), F.max("doc"), F.max("s0")).first()
    whole = [F.col("doc"), F.col("v"), F.col("s0"), F.col("cnt")]
    judged = _round(table, ["h"], bounds)
    per_doc = judged.filter("not later").groupBy("doc", "v").agg(F.collect_list(F.struct("s0", "cnt", "off")).alias("r"))  # bounded by the text's length
    once = base.select("doc", "v", "t").dropDuplicates(["doc", "v"]) if repeated else base.select("doc", "v", "t")
    made = once.join(per_doc, ["doc", "v"]).select("doc", "v", "t", "r").mapInArrow(lambda it: _groups(it, threshold), "doc long, v long, s0 long, cnt int, a1 long, a2 long, b1 long, b2 long, u long, w array<long>")
    groups = written(made.withColumn("item", F.monotonically_increasing_id()), "groups")
    release(spark)
    table = written(groups.select("item", "doc", "v", "s0", "cnt", "u").join(_doubled(groups).hint("shuffle_hash"), "item"), "doubled")
    release(spark)
    judged2 = _round(table, ["ra", "rb"], bounds)
    left = judged2.filter("not later").select("item", "doc", "v", "s0", "ra", "rb").hint("shuffle_hash").join(groups.select("item", "w"), "item")
    windows = written(left.select("doc", "v", "s0", "ra", "rb", F.posexplode("w").alias("i", "w")).select("doc", "v", (F.col("s0") + F.col("i")).alias("s0"), F.lit(1).cast("int").alias("cnt"), "ra", "rb", "w"), "windows")
    drop_scratch(groups)
    release(spark)
    at = _order(bounds)
    first = written(windows.groupBy("ra", "rb", "w").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first")
    single = join_counted(windows, first, ["ra", "rb", "w"], windows.count()).filter(at > F.col("first")).select(*whole)
    later = judged.filter("later").select(*whole).unionByName(judged2.filter("later").select(*whole)).unionByName(single)
    removed = written(later.groupBy("doc", "v").agg(F.collect_set(F.struct("s0", "cnt")).alias("r")), "removed")
    for x in (judged, judged2, windows, first):
        drop_scratch(x)
    release(spark)
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<long>" if with_text else "")
    out = base.join(removed, ["doc", "v"], "left").select("id", "t", "r").mapInArrow(lambda it: _cut(it, threshold, with_text), schema)
    return out.withColumnRenamed("id", id_col)
