"""Near-duplicate documents by HyperMinHash.

A document's set holds 64-bit hashes of its distinct word shingles. For each of
``BANDS * ROWS`` hash functions a register keeps the smallest value of the set in
16 bits: its leading zeros (6 bits) and the 10 bits behind the first one. Bands
of registers are the keys under which candidates meet; a pair is estimated from
all its registers, corrected for registers that agree by chance, and verified on
the full sets.

A pair at the threshold agrees in a band with probability ``0.7^3`` and misses
all 32 bands with probability 1.5e-6. No candidate is left out: documents with
equal sets are collapsed first; then each band's members are tried against the
smallest of them, and all others member by member, in blocks, inside the tasks,
which emit only pairs whose estimate is close enough, in the first band that a
pair shares. Where only components are asked for, pairs that are already in one
component are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import join_counted, partitions, written
from .textnum import U, distinct, mix64, pieces, shingles, texts_of, trim, words

BANDS, ROWS = 32, 3
MANTISSA = 10
SHINGLE = 5
#: A pair with a lower estimate, five standard errors of 96 registers below the threshold, is not verified.
MARGIN = 5.0
#: Ids of candidates are broadcast up to this number (8 bytes each), and joined beyond it.
BROADCAST_IDS = 4_000_000
BLOCK = 2048
#: About so many texts of one neighbourhood are verified together.
GROUP = 128
_A = mix64(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The 16-bit registers of each set, one row each; the sets must not be empty."""
    out = np.empty((len(bounds) - 1, len(_A)), dtype=np.uint16)
    step = 1 << 15
    # whole sets in chunks that stay in cache
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + step, side="right")) - 1)
        v, starts = values[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]
        least = np.empty((len(_A), b - a), dtype=U)
        for j, m in enumerate(_A):
            least[j] = np.minimum.reduceat(v * m, starts)
        out[a:b] = compress(least).T
        a = b
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit minima, in 16 bits."""
    zeros = np.zeros(least.shape, dtype=U)
    x = least.copy()
    for s in (32, 16, 8, 4, 2, 1):
        low = x < (U(1) << U(64 - s))
        zeros += np.where(low, U(s), U(0))
        x = np.where(low, x << U(s), x)
    mantissa = (x << U(1)) >> U(64 - MANTISSA)
    return ((np.minimum(zeros, U(63)) << U(MANTISSA)) | mantissa).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that one register of disjoint sets of sizes ``n`` and ``m`` agrees.

    The sum over registers of the product of both sets' probabilities to hold
    it. For minima of ``n`` and ``m`` uniform values in cells of relative width
    ``2^-MANTISSA`` this is about ``2^-MANTISSA * n * m / (n + m)^2 * 1/ln 2``-fold;
    the bound below has the exact integral over one octave.
    """
    r = n / (n + m)
    return 2.0**-MANTISSA * r * (1 - r) * 1.5


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers, less what agrees by chance."""
    c = chance(n.astype(float), m.astype(float))
    return np.clip((agree - c) / (1 - c), 0, 1)


def floor_of(threshold: float) -> float:
    return threshold - MARGIN * float(np.sqrt(threshold * (1 - threshold) / len(_A)))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, digest (of the whole set), bands, regs`` of each document; an empty set has no bands."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts_of(batch.column(1))
            for a, b in pieces(offsets):
                lo, hi = offsets[a], offsets[b]
                sets, bounds = distinct(*shingles(*words(buf[lo:hi], offsets[a : b + 1] - lo), SHINGLE))
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                digest = np.zeros((b - a, 2), dtype=U)
                regs = np.zeros((b - a, len(_A)), dtype=np.uint16)
                if len(full):
                    starts = bounds[:-1][full]
                    digest[full, 0] = np.add.reduceat(mix64(sets), starts)
                    digest[full, 1] = np.add.reduceat(mix64(sets ^ U(0x5DEECE66D1234567)), starts)
                    regs[full] = registers(sets, np.append(starts, bounds[-1]))
                keys = np.zeros((b - a, BANDS), dtype=U)
                for r in range(ROWS):
                    keys = mix64(keys * U(0x9E3779B97F4A7C15) + regs[:, r::ROWS][:, :BANDS].astype(U) + U(1))
                keys = mix64(keys + np.arange(BANDS, dtype=U) * U(0xC2B2AE3D27D4EB4F))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))), pa.int32()), pa.array(keys[full].view(np.int64).ravel())),
                        pa.array([x.tobytes() for x in regs], pa.binary()),
                    ],
                    ["id", "n_shingles", "d1", "d2", "bands", "regs"],
                )
        trim()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_shingles long, d1 long, d2 long, bands array<long>, regs binary")


def _close(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Of pairs ``a, b, an, bn, ar, br``, those whose estimate reaches ``floor``."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, len(_A)) for i in (4, 5))
            e = estimate((x == y).mean(axis=1), batch.column(2).to_numpy(), batch.column(3).to_numpy())
            batch = batch.filter(pa.array(e >= floor))
        yield batch.select([0, 1])


def _verify(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Of pairs, those with 100 * intersection >= threshold * union.

    Rows ``g, a, b, t`` in order of ``g``, in which the texts ``t`` of a group (``b`` is null) come before its pairs.
    """
    group: int | None = None
    sets: dict[int, np.ndarray] = {}
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        buf, o = texts_of(batch.column(3))
        for i, (g, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if g != group:
                group, sets = g, {}
            if b is None:
                t = buf[o[i] : o[i + 1]]
                sets[a] = distinct(*shingles(*words(t, np.array([0, len(t)])), SHINGLE))[0]
            else:
                x, y = sorted((sets[a], sets[b]), key=len)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * both >= threshold * (len(x) + len(y) - both)
        yield batch.select([1, 2]).filter(pa.array(keep))
    trim()


def _members(lists: pa.ListArray) -> list[np.ndarray]:
    """Bounds of the lists of ``rep, comp, n, regs``, and the columns of all their members, without a copy."""
    rows = lists.values
    regs = rows.field(3)
    size = len(_A) * 2
    first = np.frombuffer(regs.buffers()[1], dtype=np.int32)[regs.offset] if len(regs) else 0
    data = np.frombuffer(regs.buffers()[2], dtype=np.uint8)[first : first + size * len(regs)] if len(regs) else np.zeros(0, dtype=np.uint8)
    return [lists.offsets.to_numpy(), *[rows.field(i).to_numpy(zero_copy_only=False) for i in range(3)], data.view(np.uint16).reshape(-1, len(_A))]


def _cross(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Close pairs of two blocks of one band's members, given as lists, whose components differ, and that share no earlier band."""
    for batch in batches:
        (xo, xi, xc, xn, xr), (yo, yi, yc, yn, yr) = (_members(batch.column(c)) for c in (0, 1))
        same, bands = (batch.column(c).to_pylist() for c in (2, 3))
        out_a, out_b = [], []
        for row in range(batch.num_rows):
            y = slice(yo[row], yo[row + 1])
            ids, comps, sizes, regs = yi[y], yc[y], yn[y], yr[y]
            for i in range(xo[row], xo[row + 1]):
                other = (comps != xc[i]) & (ids < xi[i]) if same[row] else comps != xc[i]
                at = np.flatnonzero(other)
                if len(at):
                    agree = regs[at] == xr[i]
                    close = np.flatnonzero(estimate(agree.mean(axis=1), np.full(len(at), xn[i]), sizes[at]) >= floor)
                    agree = agree[close]
                    shared = np.logical_and.reduce([agree[:, r::ROWS] for r in range(ROWS)])
                    hit = ids[at[close[shared.argmax(axis=1) == bands[row]]]]
                    out_a.append(np.maximum(hit, xi[i]))
                    out_b.append(np.minimum(hit, xi[i]))
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 70) -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_shingles, component_id, kept, class_id, n_links``.

    Documents are linked when 100 times the size of the intersection of their
    sets is at least ``threshold`` times that of the union; ``component_id`` is the
    smallest id reachable over links and ``kept`` says that the document has that
    id. ``class_id`` is the smallest id with an equal set, ``n_links`` the number
    of other classes that class is linked with. Null and empty texts, and texts without
    words, have an empty set, are linked with nothing and are kept. Rows that
    repeat id and text have equal results; rows with one id and different texts are
    documents of their own, of which the smaller id names a component.
    A null id is linked with nothing (its ``component_id`` is null) and kept. An empty table gives an empty
    result. Ids must be integers. A ``threshold`` below 70, for which the bands aren't meant, or above 100 raises ``ValueError``.
    """
    return _named(docs, id_col, text_col, threshold, True).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept", "class_id", "n_links")


def _row_key(id_col: str, text_col: str, repeated: bool) -> Column:
    """What tells documents apart: the id, or if ids repeat a hash of id and text; null for a null id."""
    own = F.col(id_col).cast("long")
    return F.when(own.isNotNull(), F.xxhash64(own, F.coalesce(F.col(text_col).cast("string"), F.lit("")))) if repeated else own


def _repeat(docs: DataFrame, id_col: str) -> bool:
    return not docs.select(F.col(id_col).alias("id")).filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty()


def _named(docs: DataFrame, id_col: str, text_col: str, threshold: int, counted: bool) -> DataFrame:
    """The result of ``near_dedup`` with ``id`` and ``row_key``; ``n_links`` is whole only if ``counted``."""
    if not 70 <= threshold <= 100:
        raise ValueError(f"the threshold must be from 70 to 100, not {threshold}")
    repeated = _repeat(docs, id_col)
    keyed = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col, repeated).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    found = _linked(keyed.select("row_key", "text"), "row_key", "text", threshold, repeated, counted)
    if not repeated:
        return found.withColumn("id", F.col("row_key").cast(dict(docs.dtypes)[id_col])).withColumn("kept", F.col("row_key").eqNullSafe(F.col("component_id")))
    names = written(keyed.select("row_key", "id").filter("row_key is not null").distinct(), "names")
    known = written(found.join(names, "row_key", "left"), "keyed")
    least = lambda c: known.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias(f"least_{c}"))
    out = known.join(least("component_id"), "component_id", "left").join(least("class_id"), "class_id", "left")
    return out.select("id", "row_key", "n_shingles", F.col("least_component_id").alias("component_id"), F.col("id").eqNullSafe(F.col("least_component_id")).alias("kept"), F.col("least_class_id").alias("class_id"), "n_links")


def _linked(docs: DataFrame, id_col: str, text_col: str, threshold: int, repeated: bool, counted: bool) -> DataFrame:
    """The result of ``near_dedup`` for documents whose ids repeat only with their text; without ``counted``, only links that components need."""
    spark = docs.sparkSession
    feats = written(features(docs, id_col, text_col), "features")
    if feats.isEmpty():
        return feats.select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    full = feats.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = written(full.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    first = full.join(classes.select(F.col("rep").alias("id"), "d1", "d2"), ["id", "d1", "d2"]).dropDuplicates(["id", "d1", "d2"])
    reps = written(first.select(F.col("id").cast("long").alias("rep"), F.col("n_shingles").alias("n"), "bands", "regs"), "reps")

    # members of bands that more than one class shares, and the smallest of each band as its hub
    members = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(members.join(shared, "key"), "members")
    slim = reps.select("rep", "n", "regs")
    stars = shared.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    if counted:  # all pairs of all bands; a band of two has no more than its star
        close = _estimated(stars, slim, threshold)
        more = _blocks(shared.filter("size > 2").withColumn("comp", F.col("rep")), slim, threshold).join(stars, ["a", "b"], "left_anti")
        links = _confirmed(docs, id_col, text_col, close.unionByName(more), threshold, repeated)
        comps = components(links.select("a", "b"))
    else:
        links = _confirmed(docs, id_col, text_col, _estimated(stars, slim, threshold), threshold, repeated)
        comps = components(links.select("a", "b"))
        # bands whose members are not yet one component: each pair of components is tried
        label = shared.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        open_bands = label.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("size").alias("size")).filter((F.col("c0") < F.col("c1")) & (F.col("size") > 2)).select("key")
        rest = written(label.join(open_bands, "key").select("key", "band", "rep", "comp", "size"), "open")
        if not rest.isEmpty():
            more = _blocks(rest, slim, threshold).join(stars, ["a", "b"], "left_anti")
            links = links.unionByName(_confirmed(docs, id_col, text_col, more, threshold, repeated))
            comps = components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.select("d1", "d2", "n_shingles", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    key = ["d1", "d2", "n_shingles"]
    named = written(named.join(classes.select(*key, F.col("copies").alias("n")), key), "named")
    slim_feats = feats.select("id", *key)
    filled = slim_feats.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    joined = join_counted(filled, named, key, filled.count())
    rest = slim_feats.filter((F.col("n_shingles") == 0) | F.col("id").isNull())
    joined = joined.unionByName(rest, allowMissingColumns=True)
    alone = (F.col("n_shingles") == 0) | F.col("id").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.coalesce("component", "rep"))
    return joined.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.when(alone, F.col("id")).otherwise(F.col("rep")).alias("class_id"), F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
    )


def _estimated(pairs: DataFrame, slim: DataFrame, threshold: int) -> DataFrame:
    """Of ``pairs`` (``a`` and a hub ``b``, which may have most of them), those whose registers, from ``slim``, are close enough to be verified."""
    floor = floor_of(threshold / 100)
    pairs = written(pairs, "stars")
    left, right = (slim.select(F.col("rep").alias(s), F.col("n").alias(f"{s}n"), F.col("regs").alias(f"{s}r")) for s in ("a", "b"))
    hubs = written(right.join(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b"), "hubs")
    joined = join_counted(pairs.join(left, "a"), hubs, ["b"], pairs.count())
    return joined.select("a", "b", "an", "bn", "ar", "br").mapInArrow(lambda it: _close(it, floor), "a long, b long")


def _blocks(members: DataFrame, slim: DataFrame, threshold: int) -> DataFrame:
    """The close pairs ``a``, ``b`` of the bands in ``members`` (``key, band, rep, comp, size``) between different ``comp``, once each."""
    full = members.join(slim, "rep").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    grouped = written(full.groupBy("key", "band", "block", "blocks").agg(F.collect_list(F.struct("rep", "comp", "n", "regs")).alias("m")), "blocks")  # a block holds about BLOCK members
    left = grouped.select("key", "band", F.col("block").alias("i"), F.col("m").alias("x"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("j"))
    pairs = left.join(grouped.select("key", F.col("block").alias("j"), F.col("m").alias("y")), ["key", "j"]).select("x", "y", (F.col("i") == F.col("j")).alias("same"), "band")
    floor = floor_of(threshold / 100)
    return pairs.repartition(partitions(members.sparkSession)).mapInArrow(lambda it: _cross(it, floor), "a long, b long")


def _confirmed(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, threshold: int, repeated: bool) -> DataFrame:
    """The written links among ``pairs`` (``a`` > ``b``), verified on the texts.

    Documents that are paired with the same smallest one are neighbours, in groups of about ``GROUP``; a text goes once
    to each group, or pair of groups, that has a pair of it, not to each pair.
    """
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("other")))
    near = ends.groupBy("id").agg(F.min("other").alias("least"))
    sizes = near.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    wanted = written(near.join(sizes, "least").select("id", F.xxhash64("least", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("u")), "wanted")
    u = lambda s: wanted.select(F.col("id").alias(s), F.col("u").alias(f"{s}u"))
    others = written(u("b").join(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b"), "others")
    placed = written(join_counted(pairs.join(u("a"), "a"), others, ["b"], pairs.count()).select("a", "b", F.xxhash64(F.least("au", "bu"), F.greatest("au", "bu")).alias("g")), "placed")
    few = wanted.count() <= BROADCAST_IDS
    names = wanted.select("id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(names) if few else names, "id")
    texts = texts.groupBy("id").agg(F.min("t").alias("t")) if repeated else texts
    goes = written(placed.select("g", F.explode(F.array("a", "b")).alias("id")).distinct(), "goes")
    texts = written(texts.join(goes.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id"), "candidates")
    rows = join_counted(goes, texts, ["id"], goes.count(), wide=True).select("g", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "t")
    rows = rows.unionByName(placed.select("g", "a", "b", F.lit(None).cast("string").alias("t")))
    ordered = rows.repartition(partitions(docs.sparkSession), "g").sortWithinPartitions("g", F.col("b").asc_nulls_first())
    return written(ordered.mapInArrow(lambda it: _verify(it, threshold), "a long, b long"), "links")


def near_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 70) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component those with the smallest id.

    That is one row of each component, unless rows repeat both id and text, or one id has several texts of a component.
    """
    result = _named(docs, id_col, text_col, threshold, False)
    gone = written(result.filter(~F.col("kept")).select(F.col("row_key").alias("__gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, _row_key(id_col, text_col, _repeat(docs, id_col)) == F.col("__gone"), "left_anti")
