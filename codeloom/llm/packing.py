"""Packing documents into sequences with a grouping genetic algorithm.

Only lengths matter to a packing, and there are at most ``length`` different ones, so
a solution of the whole says how often each pattern (the lengths in a bin) is used, which plain
best fit finds from how often each length occurs. All of its bins that aren't full are packed anew, with as many full ones as
there is room for, in parts of ``WORK`` bins. The emptiest have a part of their own. Where there are many others, a part stands for 2, 4, 8 ... equal ones, which get its packing,
and what doesn't divide has parts of its own, so that the number of parts grows with the logarithm of the bins. A part can at best save the whole
bins that are free in it; at that bound it gathers what is free in few bins, which the next round puts together as the emptiest. The outcome of a round is
parted again, until the bound by the sum of lengths is reached or rounds come hardly nearer to it.

Islands run as tasks. Each breeds a population of packings of the same documents, which begins with best fits in
disturbed order (only island 0 has the plain one), and the best of an island moves to the next
one between epochs. Crossover injects whole well-filled bins of one parent, keeps the bins of
the other parent that use no document twice, and places the displaced documents. Mutation
empties the worst bins and some others. Displaced documents first change places with one or two in a bin that they fill
better (Falkenauer 1996), then go where they fit best. Then each document takes a place of its length by its
rank among the documents of that length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written
from .textnum import trim
from .tokens import encoder

Solution = dict[tuple[int, ...], int]
Bins = list[list[int]]

LENGTH = 1024
END_ID = 2
ISLANDS = 6
EPOCHS = 3
GENERATIONS = 60
POPULATION = 8
#: The bins of a part that islands pack anew.
WORK = 1024
#: Rounds in a row that bring a packing less than a twentieth nearer to its bound, after which it stays; one more if there are several parts, whose next round puts together what they gathered.
IDLE = 1
UNIT_ROWS = 1 << 20
CHUNK = 300_000


def best_fit(demand: dict[int, int], length: int) -> Solution:
    """Best fit of ``demand`` (documents by length), longest first."""
    free: dict[int, Solution] = {}
    mask = 0
    for s in sorted(demand, reverse=True):
        c = demand[s]
        while c:
            above = mask >> s
            if above:
                r = s + (above & -above).bit_length() - 1
                group = free[r]
                p, n = next(iter(group.items()))
            else:
                r, group, p, n = length, None, (), c
            k = min(r // s, c)
            use = min(n, c // k)
            q = tuple(sorted(p + (s,) * k, reverse=True))
            c -= use * k
            if group is not None:
                if n == use:
                    del group[p]
                    if not group:
                        del free[r]
                        mask &= ~(1 << r)
                else:
                    group[p] = n - use
            left = r - k * s
            target = free.setdefault(left, {})
            target[q] = target.get(q, 0) + use
            mask |= 1 << left
    out: Solution = {}
    for group in free.values():
        for p, n in group.items():
            out[p] = out.get(p, 0) + n
    return out


def place(bins: Bins, items: Iterable[int], length: int, rng: np.random.Generator | None = None) -> Bins:
    """``bins`` with ``items`` put where they fit best, longest first, and new bins; with ``rng`` some come a little before their turn."""
    free = sorted((length - sum(b), i) for i, b in enumerate(bins))
    order = sorted(items, reverse=True) if rng is None else [s for _, s in sorted((-s * (1 + 0.15 * rng.random()), s) for s in items)]
    for s in order:
        k = bisect_left(free, (s, -1))
        if k < len(free):
            left, i = free.pop(k)
            bins[i].append(s)
        else:
            left, i = length, len(bins)
            bins.append([s])
        if left > s:
            insort(free, (left - s, i))
    return bins


def exchange(bins: Bins, items: list[int], length: int, rng: np.random.Generator) -> list[int]:
    """Change up to two lengths of a bin for up to two of ``items`` that fill it better, as long as there are any; what is left over."""
    items = sorted(items)
    better = True
    while better and items:
        better = False
        for i in rng.permutation(len(bins)).tolist():
            b = bins[i]
            slack = length - sum(b)
            if not slack or not items:
                continue
            pairs = sorted((items[x] + items[y], x, y) for x in range(len(items)) for y in range(x)) if len(items) <= 24 else []
            gain, move = 0, None
            for out, leave in [(0, ()), *((x, (k,)) for k, x in enumerate(b)), *((b[x] + b[y], (x, y)) for x in range(len(b)) for y in range(x))]:
                k = bisect_right(items, out + slack) - 1
                if k >= 0 and items[k] - out > gain:
                    gain, move = items[k] - out, (leave, (k,))
                k = bisect_right(pairs, (out + slack, len(items), 0)) - 1
                if k >= 0 and pairs[k][0] - out > gain:
                    gain, move = pairs[k][0] - out, (leave, pairs[k][1:])
                if gain == slack:
                    break
            if move:
                bins[i] = [x for k, x in enumerate(b) if k not in move[0]] + [items[k] for k in move[1]]
                for k in sorted(move[1], reverse=True):
                    items.pop(k)
                for k in move[0]:
                    insort(items, b[k])
                better = True
    return items


def fitness(bins: Bins, length: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones (the mean square of their filling)."""
    return -len(bins), sum((sum(b) / length) ** 2 for b in bins) / max(len(bins), 1)


def crossover(a: Bins, b: Bins, length: int, rng: np.random.Generator) -> Bins:
    """A child of both: well-filled bins of ``b``, the bins of ``a`` that use no document twice, and the displaced documents."""
    left = Counter(s for x in a for s in x)
    child = [list(x) for x in b if rng.random() < 0.3 * (sum(x) / length) ** 8]
    for x in child:
        left.subtract(x)
    for x in sorted(a, key=sum, reverse=True):
        need = Counter(x)
        if all(left[s] >= n for s, n in need.items()):
            child.append(list(x))
            left.subtract(need)
    return place(child, exchange(child, list((+left).elements()), length, rng), length)


def mutation(a: Bins, length: int, rng: np.random.Generator, gone: int = 4) -> Bins:
    """``a`` with its two worst bins and ``gone - 2`` others emptied and their documents placed again."""
    order = sorted(range(len(a)), key=lambda i: sum(a[i]))
    out = {*order[: gone // 2], *rng.choice(len(a), min(gone - gone // 2, len(a)), replace=False).tolist()}
    keep = [list(x) for i, x in enumerate(a) if i not in out]
    return place(keep, exchange(keep, [s for i in out for s in a[i]], length, rng), length)


def gather(bins: Bins, length: int, rng: np.random.Generator) -> Bins:
    """``bins``, or fewer, in which what is free is in fewer bins: each in turn, the emptiest first, changes documents with the others, which they fill, and keeps what is left."""
    out = [b for b in bins if sum(b) == length]
    rest = sorted((b for b in bins if sum(b) < length), key=sum, reverse=True)
    done: Bins = []
    while rest:
        own = rest.pop()
        n = len(rest)
        others = rest + done
        left = exchange(others, own, length, rng)
        out += [b for b in others if sum(b) == length]
        rest = sorted((b for b in others[:n] if sum(b) < length), key=sum, reverse=True)
        done = [b for b in (*others[n:], left) if b and sum(b) < length]
    return out + done


def evolve(items: list[int], length: int, seeds: list[Bins], seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> tuple[Bins, int, int]:
    """The best packing of ``items`` on one island after its generations, which start from ``seeds`` and disturbed best fits, and the children of crossovers and of mutations that got into the population. At the bound it gathers what is free."""
    rng = np.random.default_rng(seed)
    least = -(-sum(items) // length)
    rank = lambda x: fitness(x, length)
    pool = [*seeds, *(place([], items, length, rng) for _ in range(population - len(seeds)))]
    pool.sort(key=rank, reverse=True)
    entered = [0, 0]
    for _ in range(generations):
        if len(pool[0]) <= least or len(pool) < 2:
            break
        i, j = sorted(rng.choice(len(pool), 2, replace=False).tolist())
        mutate = rng.random() < 0.5
        child = mutation(pool[i], length, rng) if mutate else crossover(pool[i], pool[j], length, rng)
        if rank(child) > rank(pool[-1]) and rank(child) not in [rank(x) for x in pool]:
            pool[-1] = child
            entered[mutate] += 1
            pool.sort(key=rank, reverse=True)
    return gather(pool[0], length, rng) if len(pool[0]) <= least else pool[0], *entered


def cells(solution: Solution, length: int, work: int, draw: int = 0) -> list[tuple[int, Bins]]:
    """Parts of ``solution`` of up to ``work`` bins, and for how many equal parts each stands.

    Every bin that isn't full is in one part, up to half of its bins, of which the first has the emptiest; the others are full ones, which ``draw`` picks
    evenly. A full bin that is in none stays as it is: full bins alone are as few as can be.
    """
    left = dict(sorted(solution.items(), key=lambda x: (sum(x[0]), x[0])))
    loose = [p for p in left if sum(p) < length]
    full = [p for p in left if sum(p) == length]
    half = max(1, work // 2)
    rng = np.random.default_rng(draw)
    bins: list[tuple[int, ...]] = []
    for p in loose:
        n = min(left[p], half - len(bins))
        bins += [p] * n
        left[p] -= n
    groups = [(1, bins)]
    times = 1
    while sum(left[p] // times for p in loose) > half:
        times *= 2
    while times:
        groups.append((times, [p for p in loose for _ in range(left[p] // times)]))
        for p in loose:
            left[p] %= times
        times //= 2
    out = []
    for times, bins in groups:
        for a in range(0, len(bins), half):
            part = bins[a : a + half]
            have = np.cumsum([left[p] // times for p in full], dtype=np.int64)
            room = min(work - len(part), int(have[-1]) if full else 0)
            if room > 0:
                at = ((np.arange(room) + rng.random()) * (int(have[-1]) / room)).astype(np.int64)
                picked = [full[k] for k in np.searchsorted(have, at, side="right").tolist()]
                for p in picked:
                    left[p] -= times
                part = part + picked
            out.append((times, [list(p) for p in part]))
    return out


def breed(spark: SparkSession, parts: list[Bins], length: int, islands: int, epochs: int, seen: dict | None = None) -> list[Bins]:
    """The best packing of each of ``parts`` that its islands found; elites migrate to the next island after each epoch. One at its bound only gathers what is free."""
    best = list(parts)
    least = [-(-sum(map(sum, x)) // length) for x in parts]
    elites = {c: [[x] if i == 0 else [] for i in range(islands if len(x) > least[c] else 1)] for c, x in enumerate(parts)}
    for epoch in range(epochs):
        if not elites:
            break
        items = {c: sorted(s for b in parts[c] for s in b) for c in elites}
        rows = [(c, i, json.dumps(items[c]), json.dumps(e)) for c, own in elites.items() for i, e in enumerate(own)]
        task = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "part int, island int, items string, seeds string")

        def run(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, island, some, seeds in zip(pdf.part, pdf.island, pdf["items"], pdf.seeds):
                    x, crossed, mutated = evolve(json.loads(some), length, json.loads(seeds), 1000 * epoch + int(island))
                    yield pd.DataFrame({"part": [part], "island": [island], "elite": [json.dumps(x)], "crossed": [crossed], "mutated": [mutated]})

        found: dict[int, list[Bins]] = {c: [] for c in elites}
        for r in sorted(task.mapInPandas(run, "part int, island int, elite string, crossed long, mutated long").collect(), key=lambda r: (r.part, r.island)):
            found[r.part].append(json.loads(r.elite))
            if seen is not None:
                seen["crossed"] = seen.get("crossed", 0) + r.crossed
                seen["mutated"] = seen.get("mutated", 0) + r.mutated
        for c, solutions in found.items():
            best[c] = max([best[c], *solutions], key=lambda x: fitness(x, length))
        elites = {c: [[x[i], x[i - 1]] for i in range(islands)] for c, x in found.items() if len(best[c]) > least[c]}
    return best


def solve(spark: SparkSession, demand: dict[int, int], length: int, islands: int = ISLANDS, epochs: int = EPOCHS, work: int = WORK, seen: dict | None = None) -> Solution:
    """The fewest bins found in rounds over all bins that aren't full; ``seen`` gets the crossovers and mutations that entered a population."""
    solution = best_fit(demand, length)
    least = -(-sum(s * c for s, c in demand.items()) // length)
    draw = idle = 0
    parts: list = []
    while (before := sum(solution.values())) > least and idle < IDLE + (len(parts) > 1):
        parts = cells(solution, length, work, draw)
        for (times, old), new in zip(parts, breed(spark, [x for _, x in parts], length, islands, epochs, seen)):
            for bins, n in ((old, -times), (new, times)):
                for b in bins:
                    p = tuple(sorted(b, reverse=True))
                    solution[p] = solution.get(p, 0) + n
        solution = {p: n for p, n in solution.items() if n}
        idle = idle + 1 if (before - sum(solution.values())) * 20 < before - least else 0
        draw += 1
    return solution


def tokenize_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: ``id, piece, start, length, ids_crc32`` and, with ``with_ids``, ``ids``."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK)))
                ids, bounds = encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                rows: list[list] = [[], [], [], [], []]
                kept = []
                source = []
                for i in range(b - a):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    first = (len(own) - 1) % length + 1
                    start = 0
                    for piece, end in enumerate(range(first, len(own) + 1, length)):
                        part = own[start:end]
                        source.append(a + i)
                        rows[0].append(piece)
                        rows[1].append(start)
                        rows[2].append(end - start)
                        rows[3].append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int64))
                        start = end
                out = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(rows[0], pa.int32()), *[pa.array(rows[i], pa.int64()) for i in (1, 2, 3)]]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(kept, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)
                a = b
        trim()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``<id>, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its text's ids and the id ``end_id``; a null or empty text is
    ``end_id`` alone. A document of more than ``length`` ids is cut into pieces of
    ``length``, of which the first may be shorter. Every row is packed: rows that
    repeat, or have a null id, are packed each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = written(tokenize_pieces(docs, vocabulary, length, end_id, id_col, text_col, with_ids), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    solution = solve(spark, {s: n for s, n in counts.items() if s < length}, length)
    if length in counts:
        solution[(length,)] = counts[length]
    slots = []  # (length, first rank, first sequence, offset): where ranks of a length go
    used: dict[int, int] = {}
    base = 0
    for p, n in sorted(solution.items(), reverse=True):
        at = 0
        for s in p:
            slots.append((s, used.get(s, 0), base, at))
            used[s] = used.get(s, 0) + n
            at += s
        base += n
    unit_count = spark.createDataFrame([(s, max(1, -(-n // UNIT_ROWS))) for s, n in counts.items()], "length long, units long")
    placed = pieces.join(F.broadcast(unit_count), "length").withColumn("unit", F.pmod(F.xxhash64("id", "piece"), F.col("units")))  # at most ``length`` rows
    before = Window.partitionBy("length").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    units = placed.groupBy("length", "unit").agg(F.count(F.lit(1)).alias("c")).select("length", "unit", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("unit_base"))
    inside = Window.partitionBy("length", "unit").orderBy("id", "piece", "ids_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1).join(units, ["length", "unit"]).withColumn("rank", F.col("rank") + F.col("unit_base"))
    ranked = ranked.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"), *(["ids"] if with_ids else []))
    table = spark.sparkContext.broadcast(np.array(sorted(slots), dtype=np.int64).reshape(-1, 4))  # as long as the patterns: those of best fit, which the lengths bound, and of the parts
    names = [c for c in ranked.columns if c not in ("rank", "ids")]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slot of each row: the last one of its length that begins at or before its rank."""
        sizes, first, sequence, offset = table.value.T
        key = (sizes << 44) | first
        for batch in batches:
            size, rank = (batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy())
            k = np.searchsorted(key, (size << 44) | rank, side="right") - 1
            out = [*(batch.column(i) for i in range(len(names))), pa.array(sequence[k] + rank - first[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays(out + ([batch.column(len(names) + 1)] if with_ids else []), [*names, "sequence_id", "offset"] + (["ids"] if with_ids else []))

    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(seat, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long" + (", ids array<long>" if with_ids else ""))
