import re

import numpy as np
import pyarrow as pa
import pytest
from codeloom.llm import topk
from codeloom.llm.license_scan import TEMPLATES, Templates, license_scan, word_shingles
from codeloom.llm.textnum import texts_of
from codeloom.llm.topk import BitSlicedBlock, exact_topk

from .cases import docs, empty, prose, texts


def brute_licenses(text):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    cut = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([tuple(w)] if w else [])
    own = cut(words)
    out = []
    for name, t in TEMPLATES.items():
        template = cut(re.findall(rb"[a-z0-9\x80-\xff]+", t.lower().encode()))
        whole, n = set(template), len(template)
        best = max((len(whole & set(own[p : p + n])) for p in range(max(1, len(own) - n + 1))), default=0) if whole & set(own) else 0
        if best >= 0.8 * len(whole):
            out.append(name)
    return ",".join(sorted(out))


def test_license_scan(spark):
    rows = texts()
    for k, (name, t) in enumerate(TEMPLATES.items()):
        w = t.split()
        rows.append((1000 + k, prose(k, 50) + " " + t + " " + prose(k + 1, 50), "a"))
        if len(w) > 12:
            rows.append((2000 + k, prose(k, 500) + " " + " ".join([*w[:5], "xx", *w[6:]]), "a"))
            rows.append((3000 + k, " ".join(w[: len(w) // 2]), "a"))
    got = sorted(((r.doc_id, r.licenses, r.n_licenses) for r in license_scan(docs(spark, rows)).collect()), key=repr)
    want = sorted(((i, brute_licenses(t), len([x for x in brute_licenses(t).split(",") if x])) for i, t, _ in rows), key=repr)
    assert got == want and sum(n for *_, n in want) >= 20
    assert license_scan(empty(spark)).count() == 0
    assert {"MIT-text", "BSD-3-Clause-text", "ISC-text"} <= {x for _, names, _ in want for x in names.split(",")}


def test_bands_retrieve_each_template(spark):
    """Every template with a word changed in every eleventh place, somewhere in other words, at a text's end and over a text's bound."""
    index = Templates(TEMPLATES)
    texts_ = []
    for k, name in enumerate(index.names):
        w = TEMPLATES[name].split()
        w = [x + "x" if len(w) > 11 and i % 11 == 10 and i > 40 else x for i, x in enumerate(w)]
        texts_ += [prose(k, 37 * k % 91) + " " + " ".join(w), " ".join(w[: len(w) // 3]), prose(k, 3)]
    h, bounds, _, _ = word_shingles(*texts_of(pa.array(texts_, pa.string())))
    got = {(i, index.names[t]) for i, t, _, _ in index.scan(h, bounds, 0.6)}
    want = set()
    for i, t in enumerate(texts_):
        for j, name in enumerate(index.names):
            if index.verify(h[bounds[i] : bounds[i + 1]], j)[0] >= 0.6:
                want.add((i, name))
    assert got == want and len(want) > 24


def brute_topk(rows, queries, k):
    out = []
    for q, v in queries:
        s = sorted((-int(np.dot(v, u)), i) for i, u in rows if i != q)[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def vectors(n, dim, seed, scale=1.0):
    x = np.random.default_rng(seed).normal(0, scale, (n, dim)).astype(np.float32)
    x[1::50] = x[0]  # ties
    return x


def test_topk_is_exact(spark):
    x = vectors(700, 9, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 9), (2003, [float("inf")] * 9), (None, [1.0] * 9), (2100, [0.5] * 4), (2200, [])]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<float>, id string").repartition(3)
    whole = {i: np.floor(1024 * np.pad(np.array(v, dtype=float), (0, 9 - len(v)))).astype(np.int64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    queries = df.filter("vec_id % 100 = 0")
    want = brute_topk(list(whole.items()), [(i, v) for i, v in whole.items() if i % 100 == 0], 10)
    for block, q_block in ((1 << 16, 1 << 12), (128, 3)):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk(df, queries, block=block, query_block=q_block).collect())
        assert got == want
    few = exact_topk(df.filter("vec_id in (0, 1, 2)"), df.filter("vec_id = 0")).collect()
    assert len(few) == 2
    assert exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_with_a_hot_repeated_id(spark):
    x = np.floor(1024 * vectors(600, 9, 3).astype(float)).astype(np.int64)
    ids = np.arange(600)
    ids[200:240], x[200:240] = 100, 3 * x[100]  # copies of the query's id that score highest
    ids[300:320], x[300:320] = 7, x[7]  # a candidate that is repeated
    rows = [(int(i), (v / 1024).tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = [(int(i), v) for i, v in zip(ids, x) if i % 100 == 0]
    s = {q: sorted((-int(v @ u), int(i)) for p, v in asked if p == q for i, u in zip(ids, x) if i != q)[:10] for q, _ in asked}
    want = sorted((q, r + 1, i, -y) for q, found in s.items() for r, (y, i) in enumerate(found))
    got = exact_topk(df, df.filter("vec_id % 100 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want and len(want) == 10 * len(s)


def search(block, q, v, k):
    return block.search(np.array([q]), v[None, :], k)[0]


def test_bitmaps_select_few_rows():
    x = np.floor(1024 * vectors(5000, 16, 2, 0.25).astype(float)).astype(np.int64)
    b = BitSlicedBlock(np.arange(5000), x)
    seen = []
    inner = b.at_least
    b.at_least = lambda *a: (lambda r: (seen.append(len(r)), r)[1])(inner(*a))
    asked = np.arange(0, 5000, 500)
    want = brute_topk(list(enumerate(x)), [(q, x[q]) for q in asked.tolist()], 10)
    for group in (1, 1 << 16):
        topk.TOGETHER = group
        got = [(int(q), r + 1, int(i), int(s)) for q, (rows, scores) in zip(asked, b.search(asked, x[asked], 10)) for r, (i, s) in enumerate(zip(rows, scores))]
        assert sorted(got) == want
    topk.TOGETHER = 4096
    assert np.mean(seen) < 1000


def test_constant_and_extreme_vectors():
    x = np.tile(np.array([[5, -7, 0]]), (200, 1))
    b = BitSlicedBlock(np.arange(200), x)
    rows, scores = search(b, 3, x[0], 4)
    assert rows.tolist() == [0, 1, 2, 4] and set(scores.tolist()) == {74}
    assert search(b, -1, np.zeros(3, dtype=np.int64), 2)[1].tolist() == [0, 0]
    few = BitSlicedBlock(np.arange(3), x[:3])
    assert search(few, 1, x[0], 10)[0].tolist() == [0, 2]


def test_large_components(spark):
    """Components beyond 32 bits are exact, as long as the inner products fit in 64 bits."""
    r = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r.integers(-3_000_000, 3_000_000, 4)]) for i in range(300)]
    whole = {i: [int(np.floor(1024 * v)) for v in x] for i, x in rows}
    small = {i: [v / 4096 for v in x] for i, x in rows if i % 100 == 0}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x) for i, x in small.items()], "vec_id long, embedding array<double>")
    want = []
    for q, x in small.items():
        w = [int(np.floor(1024 * v)) for v in x]
        found = sorted((-sum(a * b for a, b in zip(w, u)), i) for i, u in whole.items() if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk(df, asked, chunk_bytes=1, query_block=1).collect()) == sorted(want)
    assert max(abs(v) for u in whole.values() for v in u) > 1 << 31
    with pytest.raises(Exception, match="64"):
        exact_topk(df.unionByName(df.selectExpr("vec_id + 1000 AS vec_id", "transform(embedding, x -> x * 1e9) AS embedding")), df.filter("vec_id = 0")).collect()
