import collections
import hashlib
import re
import zlib

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from codeloom.llm.mixing import mix
from codeloom.llm.near_dedup import near_dedup
from codeloom.llm.packing import best_fit, cells, gather
from codeloom.llm.queries import QUERIES, VOCABULARY
from codeloom.llm.sql import ORACLES
from codeloom.llm.toxicity import toxicity
from tokenizers import Tokenizer

from .cases import SCHEMA, docs, empty, texts
from .test_dedup import brute_components
from .test_layout import brute_targets

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = list(entry.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names and len(QUERIES) == 10


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    """The queries that SQL can express, against their twins."""
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    twin = c.execute(ORACLES[name])
    names = sorted(x[0] for x in twin.description)
    at = [[x[0] for x in twin.description].index(n) for n in names]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in twin.fetchall())


def test_stages_on_awkward_rows(spark):
    d = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        if name != "packing":
            assert out.schema == d.schema, name
            out = spark.createDataFrame(out.collect(), SCHEMA)
        assert stage(spark, empty(spark), SF).count() == 0, name
        d = out
    assert d.count() >= len({t for _, t, _ in texts() if t}) // 2


def brute_mix(rows):
    """How often each of ``(id, size, source)`` is taken: whole epochs, the rows before the cut in order of their key, and the row that fills best."""
    sizes = collections.Counter()
    for _, n, s in rows:
        sizes[s] += n
    want, out = brute_targets(dict(sizes)), collections.Counter()
    for s, total in sizes.items():
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, n, x in rows if x == s)
        epochs = min(int(want[s] // total), 3) if total else 0
        rest, at, left = want[s] - epochs * total, 0, []
        for key, i, n in own:
            out[i] += epochs
            if at + n <= rest and not left:
                at += n
                out[i] += 1
            else:
                left.append((abs(rest - at - n), key, i, n))
        gap = rest - at
        fits = [x for x in left if gap > 0.5 and 0 < x[3] < 2 * gap]
        if fits:
            out[min(fits)[2]] += 1
    return +out


def test_run_equals_brute_force(spark):
    """Every stage, and the rows of ``run``, against plain Python; the toxicity model itself is compared with its own scores and its labels."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity(d, labels).collect()}
    kept = {r.doc_id: r.text or "" for r in d.collect() if not scores[r.doc_id]}
    source = {r.doc_id: r.source for r in d.collect()}
    assert {r.doc_id for r in corpus_pipeline.toxicity(spark, d, SF).collect()} == set(kept)
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert len(set(scores) - set(kept) - toxic) <= 0.01 * len(scores)

    last = {}
    for i, t in kept.items():
        last[t] = max(last.get(t, i), i)
    kept = {i: t for t, i in last.items()}
    component = brute_components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if component[i][1] == i}
    times = brute_mix([(i, len(re.findall(r"[^\x20\x09-\x0D]+", t)), source[i]) for i, t in kept.items()])

    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter()
    for i, n in times.items():
        ids = [*tokenizer.encode(kept[i], add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += n
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    assert len(sequences) <= sum(best_fit(dict(collections.Counter(r.length for r in got)), 1024).values())


def test_each_stage_does_its_work(spark):
    """Each stage's rows against what its operator, or brute force, says of its input."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, after = d.collect(), stage(spark, d, SF).collect()
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert len(gone - toxic) <= 0.02 * len(before)
        elif name == "exact dedup":
            keep = {}
            for r in before:
                keep[r.text or ""] = max(keep.get(r.text or "", r.doc_id), r.doc_id)
            assert {r.doc_id for r in after} == set(keep.values())
        elif name == "near dedup":
            assert {r.doc_id for r in after} == {r.doc_id for r in near_dedup(d).filter("kept").collect()}
        else:
            assert collections.Counter(r.doc_id for r in after) == {r.doc_id: r.times for r in mix(d).collect() if r.times}
        d = spark.createDataFrame(after, d.schema)


def test_packing_stage_packs_all_bins_anew(spark):
    """Documents of 60 triplets of lengths, 30 of each, fill 1800 sequences, best fit needs 2065."""
    rng = np.random.default_rng(1)
    trips = [(a, b, 1024 - a - b) for a, b in zip(rng.integers(400, 500, 60).tolist(), rng.integers(260, 300, 60).tolist())]
    sizes = [s for t in trips for s in t for _ in range(30)]
    got = corpus_pipeline.packing(spark, docs(spark, [(i, " ".join(["a"] * (s - 1)), "a") for i, s in enumerate(sizes)]), SF).collect()
    assert sorted(r.length for r in got) == sorted(sizes)
    filled = collections.Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    plain = sum(best_fit(dict(collections.Counter(sizes)), 1024).values())
    assert max(filled.values()) <= 1024 and len(filled) - 1800 <= (plain - 1800) // 8, (plain, len(filled))


def test_parts_of_the_packing_stage_can_save_what_the_whole_can():
    """954 bins with 2 free each: 1908 are a bin of 1024, and less than that is free in each of two equal halves."""
    for solution in ({(600, 422): 954, (512, 512): 5000}, {(600, 422): 20_000, (1000, 23): 300, (512, 512): 5000}):
        free = sum((1024 - sum(p)) * n for p, n in solution.items())
        saved = [times * (len(bins) - -(-sum(map(sum, bins)) // 1024)) for times, bins in cells(solution, 1024, 1024)]
        assert saved[0] >= 1 and sum(saved) <= free // 1024
    assert gather([[50, 49], [51, 48], [60, 40]], 100, np.random.default_rng(0))[1:] in ([[51, 49], [50, 48]], [[49, 51], [48, 50]], [[49, 51], [50, 48]], [[51, 49], [48, 50]])
    rng = np.random.default_rng(3)
    bins = [[int(a), 99 - int(a)] for a in rng.integers(20, 80, 60)]
    out = gather(bins, 100, rng)
    assert sorted(s for b in out for s in b) == sorted(s for b in bins for s in b) and max(map(sum, out)) <= 100 and len(out) <= 60
    assert sum(sum(b) < 100 for b in out) < 30
