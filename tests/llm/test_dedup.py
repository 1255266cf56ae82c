import collections
import hashlib
import re

import pytest
from codeloom.llm.components import components
from codeloom.llm.exact_dedup import build_directory, exact_dedup, exact_dedup_rows
from codeloom.llm.near_dedup import estimate, near_dedup, near_dedup_rows, registers
from codeloom.llm.suffix_dedup import suffix_dedup

from .cases import SCHEMA, docs, empty, prose, texts

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_directory_splits_and_doubles():
    slots = build_directory({0: (10, 100), 1: (1, 10), 7: (10, 100)}, 3, 4, 2)
    assert len(slots) == 8 and [p for p, *_ in slots] == list(range(8))
    assert len({b for _, b, *_ in slots}) < 8 and {o for *_, o in slots} == {0, 1}
    assert build_directory({}, 0, 4, 2) == [(0, 0, 0, 0)]


@pytest.mark.parametrize("capacity", [None, 1])
def test_exact_dedup(spark, capacity):
    got = exact_dedup(docs(spark), capacity=capacity).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in texts():
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)


def test_exact_dedup_rows_keep_columns(spark):
    got = exact_dedup_rows(docs(spark))
    assert got.schema == docs(spark).schema
    assert sorted(r.text or "" for r in got.collect()) == sorted({t or "" for _, t, _ in texts()})
    assert exact_dedup_rows(empty(spark)).count() == 0 and exact_dedup(empty(spark)).count() == 0


def test_hot_text(spark, monkeypatch):
    """A text on two thirds of all rows, above the limit and below it; no task gets more than a part of its copies."""
    from codeloom.llm import exact_dedup as E
    from codeloom.llm import shared

    rows = [(i, "hot" if i % 3 else f"text {i}", "a") for i in range(6000)]
    for limit in (100, 10**9):
        for m in (E, shared):
            monkeypatch.setattr(m, "hot_limit", lambda *_: limit)
        got = exact_dedup(docs(spark, rows).repartition(20))
        assert got.filter("kept").count() == 2001 and got.filter("group_size = 4000 and keep_id = 5999").count() == 4000
        assert {r.doc_id for r in exact_dedup_rows(docs(spark, rows)).collect()} == {i for i, t, _ in rows if t != "hot"} | {5999}


def test_lookup_goes_through_the_directory(spark):
    """A row's bucket is that of its slot: the directory's bucket for the first bits of its key."""
    found, index = E_index(spark)
    assert found.select("bucket").distinct().count() > 4
    assert found.join(index, ["bucket", "key", "sha"]).count() == found.count() == 500


def E_index(spark):
    from codeloom.llm.exact_dedup import build_index

    return build_index(docs(spark, [(i, f"text {i % 300}", "a") for i in range(500)]), capacity=16)


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, u in sets:
            if a < b and s and u and 100 * len(s & u) >= 70 * len(s | u):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_dedup(spark):
    got = near_dedup(docs(spark))
    want = brute_components({(i, t) for i, t, _ in texts() if i is not None})
    rows = got.collect()
    assert len(rows) == len(texts())
    assert all((r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id) for r in rows if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = near_dedup_rows(docs(spark))
    assert kept.schema == docs(spark).schema and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, (_, c) in want.items() if i == c}
    assert near_dedup(empty(spark)).count() == 0 and near_dedup_rows(empty(spark)).count() == 0


def test_chain_of_near_copies(spark):
    """Links whose ends aren't linked themselves still make one component, whatever the hubs are."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        own = words[:]
        for j in range(i):
            own[(j * 7) % 100] = f"x{j}"
        rows.append((100 - i, " ".join(own), "a"))
    want = brute_components([(i, t) for i, t, _ in rows])
    assert {r.doc_id: r.component_id for r in near_dedup(docs(spark, rows)).collect()} == {i: c for i, (_, c) in want.items()}


def test_links_inside_a_component_are_counted(spark):
    """Variants of one template, most of which link with each other, in more than one group of texts."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        own = words[:]
        for j in range(1 + i % 8):
            own[(i * 37 + j * 11) % 200] = f"x{i}"
        rows.append((i, " ".join(own), "a"))
    rows += [(1000, rows[7][1], "a"), (1001, prose(1, 80), "a")]
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for i, t, _ in rows if i != 1000}
    want = {i: sum(j != i and 100 * len(s & u) >= 70 * len(s | u) for j, u in sets.items()) for i, s in sets.items()}
    assert max(want.values()) > 200 and want[1001] == 0 and len(set(want.values())) > 5
    assert {r.doc_id: r.n_links for r in near_dedup(docs(spark, rows)).collect()} == want | {1000: want[7]}


def test_hot_hub_and_band(spark, monkeypatch):
    """Half of all rows are variants of one text, which meet in all bands; every key with more than ten rows counts as hot."""
    from codeloom.llm import shared

    monkeypatch.setattr(shared, "hot_limit", lambda *_: 10)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[: 40 + i % 60] + [f"z{i}"] + base[40 + i % 60 :]), "a") for i in range(150)] + [(1000 + i, prose(i, 60), "a") for i in range(150)]
    rows += [(2000 + i, rows[3][1], "a") for i in range(40)]
    want = brute_components([(i, t) for i, t, _ in rows])
    got = near_dedup(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert {r.n_links for r in got if r.doc_id < 150} == {149} and {r.n_links for r in got if 1000 <= r.doc_id < 2000} == {0}
    assert {r.doc_id for r in near_dedup_rows(docs(spark, rows)).collect()} == {i for i, (_, c) in want.items() if i == c}
    with pytest.raises(ValueError):
        near_dedup(docs(spark), threshold=50)


def test_one_id_with_several_texts(spark):
    base = prose(5, 100)
    rows = [(7, base, "a"), (7, base + " more", "a"), (7, prose(6, 100), "a"), (9, prose(6, 100) + " end", "a"), (3, prose(8, 50), "a"), (3, base + " other", "a")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs(spark, rows)).collect())
    assert got == [(3, 46, 3, True), (3, 97, 3, True), (7, 96, 3, False), (7, 96, 7, True), (7, 97, 3, False), (9, 97, 7, False)]
    assert sorted((r.doc_id, r.text) for r in near_dedup_rows(docs(spark, rows)).collect()) == sorted([(3, rows[4][1]), (3, rows[5][1]), (7, rows[2][1])])


def test_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.8):
        n = 2000
        both = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = (np.concatenate((both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64) * np.uint64(2))) for _ in range(2))
        x, y = registers(np.concatenate((a, b)), np.array([0, n, 2 * n]))
        true = len(both) / (2 * n - len(both))
        assert abs(float(estimate((x == y).mean(), np.array(n), np.array(n))) - true) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_suffix(rows, threshold):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - threshold + 1):
            k = (-(1 << 63) if i is None else i, s)
            w = b[s : s + threshold]
            seen[w] = min(seen.get(w, k), k)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - threshold + 1):
            if seen[b[s : s + threshold]] < (-(1 << 63) if i is None else i, s):
                cover[s : s + threshold] = b"\1" * threshold
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((i, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def test_suffix_dedup(spark):
    rows = [(i, t) for i, t, _ in texts()]
    assert sorted(repr(tuple(r)) for r in suffix_dedup(docs(spark)).collect()) == brute_suffix(rows, 100)
    assert suffix_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("threshold", [64, 100, 300])
def test_suffix_dedup_of_shifted_and_nested_repeats(spark, monkeypatch, threshold):
    """Passages that begin and end anywhere, lie in one another, repeat within a text and differ in one byte; one on half of all rows."""
    import random

    from codeloom.llm import shared

    monkeypatch.setattr(shared, "hot_limit", lambda *_: 20)
    r = random.Random(threshold)
    source = "".join(chr(r.randrange(97, 107)) for _ in range(3000)) + "é日" * 400 + "ab" * 500
    rows = []
    for i in range(160):
        a = r.randrange(len(source))
        cut = source[a : a + r.randrange(20, 900)]
        k = r.randrange(max(1, len(cut)))
        rows.append((r.randrange(10**9), cut[:k] + r.choice(["", "#", str(i)]) + cut[k:] + (source[200:900] if i % 2 else ""), "a"))
    got = suffix_dedup(docs(spark, rows), threshold=threshold).collect()
    assert sorted(repr(tuple(x)) for x in got) == brute_suffix([(i, t) for i, t, _ in rows], threshold)
    for bad in (63, 1001):
        with pytest.raises(ValueError):
            suffix_dedup(docs(spark), threshold=bad)


def test_suffix_dedup_of_a_text_in_segments(spark, monkeypatch):
    """A text above 8 MiB is cut into segments that overlap; repeats across their bounds are found."""
    from codeloom.llm import suffix_dedup as S

    long = "".join(chr(97 + (x * x * 7 + x // 3) % 23) + str(x) for x in range(1_300_000))
    at = S.SEGMENT - 150
    assert len(long) > S.SEGMENT + 1000
    rows = [(1, long), (2, "zz" + long[at : at + 400] + "zz"), (3, long[-130:] + long[:120])]
    got = {r.doc_id: r for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got[1].n_removed == 0 and got[1].n_bytes == len(long)
    assert got[2].spans == [2, 402] and bytes(got[2].kept) == b"zzzz"
    assert got[3].spans == [0, 250]


def test_suffix_dedup_returns_texts(spark):
    d = spark.createDataFrame([(1, "x" * 3 + "q" * 10 + "abcdefghij" * 9), (2, "é" + "abcdefghij" * 9 + "z")], "doc_id int, text string")
    got = {r.doc_id: r for r in suffix_dedup(d, threshold=80, with_text=True).collect()}
    assert bytes(got[2].kept) == "éz".encode() and got[2].spans == [2, 92] and got[2].n_spans == 1


def test_suffix_dedup_works_on_many_texts_at_once():
    """The groups of 400 texts come in one batch, with the names that each text has alone; runs end with their text."""
    import pyarrow as pa
    from codeloom.llm import suffix_dedup as S

    texts_ = [prose(i, 40) for i in range(400)]
    units = [[{"s0": i % 7 + k, "cnt": 3 + i % 20, "off": 30} for k in (0, 40)][: 1 + i % 2] for i in range(400)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(400), pa.int64()), pa.array([0] * 400, pa.int64()), pa.array(texts_), pa.array(units, pa.list_(pa.struct([("s0", pa.int64()), ("cnt", pa.int32()), ("off", pa.int32())])))], ["doc", "v", "t", "r"]
    )
    got = list(S._groups(iter([batch]), 100))
    alone = [r for i in range(400) for x in S._groups(iter([batch.take(pa.array([i]))]), 100) for r in x.to_pylist()]
    assert len(got) == 1 and got[0].to_pylist() == alone
    spans = pa.array([[{"s0": 0, "cnt": 1}], None, [{"s0": 0, "cnt": 11}, {"s0": 5, "cnt": 2}], []], pa.list_(pa.struct([("s0", pa.int64()), ("cnt", pa.int32())])))
    cut = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(["x" * 100, "", "y" * 110, "z"]), spans], ["id", "t", "r"])
    out = [r for x in S._cut(iter([cut]), 100, True) for r in x.to_pylist()]
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"], r["spans"]) for r in out] == [(100, 100, 1, b"", [0, 100]), (0, 0, 0, b"", []), (110, 110, 1, b"", [0, 110]), (1, 0, 0, b"z", [])]


def test_schema_is_awkward():
    assert "id string" in SCHEMA
