import re

import numpy as np
from codeloom.llm import quality as Q
from codeloom.llm import toxicity as X
from codeloom.llm.hashed import labelled
from codeloom.llm.queries import op4_toxicity, op9_quality
from pyspark.sql import functions as F

from .cases import docs, empty, prose, texts

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(spark, n=400):
    rows = [(i, prose(i, 20) + (" you blargh fool " if i % 4 == 0 else " ") + prose(i + 1000, 20), "a") for i in range(n)]
    return docs(spark, rows + [(None, None, None), (9999, "", "a")]), labels(spark, [(i, 0 if i % 4 == 0 else 2, int(i % 4 == 0)) for i in range(n)] + [(None, 1, 1), (5, None, None)])


PAIRS = [("skunkish", "outgroup"), ("vermin", "newcomers"), ("skunkish", "newcomers"), ("vermin", "outgroup"), ("skunkish",), ("vermin",), ("outgroup",), ("newcomers",), ()]


def paired(spark, n):
    """Each of four words is harmless alone, and so are two of their pairs; two other pairs are toxic."""
    which = [PAIRS[i % len(PAIRS)] for i in range(n)]
    rows = []
    for i, w in enumerate(which):
        own = prose(i, 30).split()
        for k, x in enumerate(w):
            own.insert((7 * i + 11 * k) % 30, x.title() if i % 2 else x)
        rows.append((i, " ".join(own), "a"))
    return docs(spark, rows), labels(spark, [(i, 0, int(w in PAIRS[:2])) for i, w in enumerate(which)])


def test_pairs_of_terms_decide(spark):
    """No sum of weights tells the toxic pairs from the harmless ones; the machine does, on rows that it never saw."""
    d, l = paired(spark, 3000)
    truth = l.select("doc_id", "toxic")
    wrong = {}
    for rank in (0, X.RANK):
        got = X.toxicity(d, l, rank=rank).filter("held_out").join(truth, "doc_id").toPandas()
        wrong[rank] = ((got.predicted != got.toxic).mean(), (got.predicted[got.toxic == 1] == 1).mean())
    assert wrong[0][0] > 0.2 and wrong[X.RANK][0] < 0.02 and wrong[X.RANK][1] > 0.9, wrong


def test_score_equals_the_sum_over_all_pairs(spark):
    d, l = paired(spark, 1500)
    m = X.train(d, l)
    assert (m.factors != 0).any()
    number = {b: i for i, b in enumerate(m.buckets.tolist())}
    some = docs(spark, texts() + [(90, "Vermin! vermin newcomers, OUTGROUP", "a"), (91, "skunkish " * 50 + "outgroup", "a")])
    want = {}
    for i, t in [(r.doc_id, r.text) for r in some.collect()]:
        found = set()
        for word in re.findall(rb"[a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())):
            h, _ = X.terms(np.frombuffer(word, dtype=np.uint8), np.array([0, len(word)]), X.BITS)
            found |= {number[x] for x in h.tolist() if x in number}
        own = sorted(found)
        z = m.bias + sum(m.weights[x] for x in own) + sum(float(m.factors[x] @ m.factors[y]) for a, x in enumerate(own) for y in own[:a])
        want.setdefault(i, set()).add(round(1 / (1 + np.exp(-z)), 9))
    assert len({x for v in want.values() for x in v}) > 2
    assert all(round(r.score, 9) in want[r.doc_id] for r in X.score(some, m).collect())


def test_sample_does_not_depend_on_partitions(spark):
    """An id with several texts is learnt from with the same one in any run."""
    d, l = paired(spark, 300)
    twice = d.unionByName(d.withColumn("text", F.concat("text", F.lit(" vermin newcomers"))))
    a, b = (sorted(map(tuple, labelled(x, l, "toxic", 200).collect())) for x in (twice, twice.repartition(5, "text")))
    assert a == b and len(a) == 200
    assert sorted(map(tuple, X.toxicity(twice, l).collect())) == sorted(map(tuple, X.toxicity(twice.repartition(7), l).collect()))


def test_toxicity_finds_the_insult(spark):
    d, l = corpus(spark)
    got = X.toxicity(d, l).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert all(not r.predicted for r in got if r.doc_id is None or r.doc_id == 9999)
    kept = X.toxicity_rows(d, l)
    assert kept.schema == d.schema and kept.count() == 302


def test_toxicity_without_labels_or_rows(spark):
    d, l = corpus(spark, 8)
    none = X.toxicity(d, l.limit(0)).collect()
    assert len({r.score for r in none}) == 1 and len(none) == 10
    assert X.toxicity(empty(spark), l).count() == 0 and X.toxicity_rows(empty(spark), l).count() == 0
    assert len({r.score for r in X.toxicity(docs(spark), labels(spark, [(10, 0, 1)])).collect()}) == 1


def test_held_out_labels_are_not_learnt(spark):
    d, l = corpus(spark)
    flipped = l.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, round(r.score, 9)) for r in X.toxicity(d, x).collect()} for x in (l, flipped))
    assert a == b


def test_toxicity_query_on_held_out_rows(spark):
    """A seventh of the toxic labels of these tables is on texts without any insult, which nothing can find."""
    got = op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 4 and ((got.predicted == 1) & (got.toxic == 1)).sum() >= 0.8 * (got.toxic == 1).sum()


def test_ordered_grades():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (3000, 5)).astype(np.float32)
    z = x @ np.array([2, -1, 0, 0, 1]) + rng.logistic(0, 0.3, 3000)
    y = np.digitize(z, [-1.5, 0.5, 2.0]) * 10
    m = Q.fit(x, y)
    p = m.probabilities(x)
    assert m.grades == [0, 10, 20, 30] and (np.diff(m.thresholds) > 0).all() and np.allclose(p.sum(axis=1), 1)
    assert (np.array(m.grades)[p.argmax(axis=1)] == y).mean() > 0.8
    assert abs(np.corrcoef(p @ np.array(m.grades), z)[0, 1]) > 0.9
    assert Q.fit(x[:5], np.full(5, 3)).probabilities(x).tolist() == [[1.0]] * 3000


def test_quality_of_awkward_rows(spark):
    d, l = corpus(spark, 60)
    got = Q.quality(d, l).collect()
    assert len(got) == 62 and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 and r.predicted_grade in (0, 2) for r in got)
    assert Q.quality(empty(spark), l).count() == 0 and Q.quality(docs(spark), l).count() == len(texts())
    assert {r.expected_grade for r in Q.quality(d, l.limit(0)).collect()} == {0.0}


def test_quality_query_on_held_out_rows(spark):
    got = op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter(X.held_out(F.col("doc_id"))).toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.9
