"""What queries may need as tables grow: no shuffle or sort of postings and contents that grows faster than these, and no texts in Python."""

import random

from codeloom.operators import chunks, fts, graph
from codeloom.plans import catalogue
from codeloom.plans.store import Store
from codeloom.sources import corpus
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cuts(text, window=800, least=400):
    out, a = [], 0
    while a < len(text):
        b = len(text)
        if b - a > window:
            newline = text.rfind("\n", a, a + window)
            b = newline + 1 if newline - a > least else a + window
        out.append((a, b))
        a = b
    return out


def test_hard_split_equals_a_loop_and_needs_no_python(spark):
    r = random.Random(1)
    texts = [None, "", " \t\n\v", "\n" * 2000, " " * 1700 + "x", "x" * 800, "x" * 801, "\U0001f600" * 1700, "a\U0001f600" * 900, "x" * 400 + "\n" + "y" * 900, "x" * 401 + "\n" + "y" * 900, "x" * 799 + "\ny", "\r\n" * 900, "\x85" * 900, "ab\n" * 100_000]
    texts += ["".join(r.choice(["a", " ", "\n" if r.random() < 0.1 else "b", "\U0001f600", "ü"]) for _ in range(r.randint(0, 5000))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = chunks.hard_split(df, ["id"], "text")
    assert "Python" not in plan(made) and "InArrow" not in plan(made) and "Exchange" not in plan(made)
    want = []
    for i, t in enumerate(texts):
        line = 1
        for seq, (a, b) in enumerate(cuts(t or ""), 1):
            more = t.count("\n", a, b)
            want += [(i, seq, a, b, line, line + more, t[a:b])] * bool(t[a:b].strip(" \t\n\r\f\v"))
            line += more
    assert sorted(map(tuple, made.collect())) == want
    other = chunks.hard_split(df, ["id"], "text", 10, 3).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("at")).collect()
    assert all([tuple(x) for x in r.at] == [(a, b) for a, b in cuts(texts[r.id], 10, 3) if texts[r.id][a:b].strip(" \t\n\r\f\v")] for r in other)


def test_chunks_of_documents_are_made_without_python(spark):
    for name in ("q_hard_split", "q_filter_category"):
        assert "InArrow" not in plan(catalogue.QUERIES[name](spark, SF)), name


def test_posting_lists_hold_each_id_once_and_are_not_shuffled(spark):
    rows = [(f"{i:05d}", ["alpha beta", "beta", "", None][i % 4], ["Beta the gamma beta", None, "gamma", "alpha. alpha, delta"][i % 4] if i % 7 else f"word{i}") for i in range(fts.SEGMENT + 900)]
    nodes = spark.createDataFrame(rows, "node_id string, tags string, content string").coalesce(1).cache()
    index = fts.posting_lists(nodes)
    assert "Exchange" not in plan(index) and "Sort" not in plan(index)
    index = index.cache()
    held = [i for r in index.filter("ids is not null").collect() for i in r.ids]
    assert sorted(held) == [r[0] for r in rows] and index.select("segment").distinct().count() >= 2
    pairs = index.filter("term <> ''").select("segment", "term", "weight_class", F.inline(F.arrays_zip("at", "tf")))
    ids = index.filter("term = ''").select("segment", F.posexplode("ids").alias("at", "node_id"))
    assert sorted(map(tuple, pairs.join(ids, ["segment", "at"]).select("term", "weight_class", "node_id", "tf").collect())) == sorted(map(tuple, fts.postings(nodes).collect()))
    for query in ("beta", "alpha or delta", "gamma -alpha", "word7", "alpha beta gamma", "none", '"gamma beta"', 'beta -"gamma beta"', ""):
        assert [tuple(x) for x in fts.search_index(index, nodes, query, 40).collect()] == [tuple(x) for x in fts.search(nodes, query, 40).collect()], query
    assert fts.search_index(index, nodes.filter("node_id > '09000'"), "beta", 5).first().node_id > "09000"
    assert fts.posting_lists(nodes.limit(0)).count() == 0


def test_contents_are_shuffled_once_and_stored_once(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    text = lambda c: F.concat(F.lit("text "), c.cast("string"))
    made = lambda a, b: spark.range(a, b).select(F.sha2(text(F.col("id")), 256).alias("chunk_hash"), text(F.col("id")).alias("content"))
    s.add_contents(made(0, 300).unionByName(made(0, 100)))
    s.add_contents(made(200, 500).unionByName(made(450, 500)))
    assert sorted(map(tuple, s.contents().collect())) == sorted(map(tuple, made(0, 500).collect()))
    seen = []
    write = Store.write
    try:
        Store.write = lambda self, name, df, folder=None: seen.append(plan(df))
        s.add_contents(made(0, 9))
        s.write("posting_lists", fts.posting_lists(spark.createDataFrame([("1", "a b", "c")], "node_id string, tags string, content string")))
    finally:
        Store.write = write
    assert seen[0].count("Exchange") == 1 and seen[1].count("Exchange") == 0


def test_hits_are_described_without_a_shuffle_of_all_nodes(spark):
    e = corpus.engine(spark, SF)
    nodes = e._bare("s2")
    at = nodes.filter("start > 0").orderBy("node_id").limit(3).select("node_id")
    ids = {r.node_id for r in at.collect()}
    at = spark.createDataFrame([(i,) for i in ids], "node_id string")
    own = e.edges("s2").join(at.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    n = graph.around(own, nodes, at)
    assert "Exchange hashpartitioning" not in plan(n.select("node_id")).split("BroadcastExchange")[0]
    for whole, part in ((graph.parents(own, nodes), graph.parents(own, n)), (graph.neighbours(nodes, "next", at), graph.neighbours(n, "next", at)), (graph.neighbours(nodes, "prev", at), graph.neighbours(n, "prev", at)), (graph.outgoing(own, graph.with_external(own, nodes)), graph.outgoing(own, graph.with_external(own, n)))):
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, part.collect()))
    assert n.count() < nodes.count() / 2


def test_postings_of_an_older_store_become_lists(spark, tmp_path):
    rows = [(f"n{i}", "tag", f"license word{i % 3} rights" if i % 2 else "rights rights") for i in range(50)]
    nodes = spark.createDataFrame(rows, "node_id string, tags string, content string")
    s = Store(spark, str(tmp_path))
    old = fts.postings(nodes, stems=True).withColumn("snapshot_id", F.lit("s1")).withColumn("bucket", fts.bucket_of(F.col("term")))
    old.write.partitionBy("snapshot_id", "bucket").parquet(str(tmp_path / "tables/postings"))
    s._create("version", "2")
    assert s.migrate() == 2 and not (tmp_path / "tables/postings").exists()
    index = s.read("posting_lists", "s1")
    for query in ("license or right", "rights -license", "word1"):
        assert fts.search_index(index, nodes, query, 60, stems=True, bucketed=True).collect() == fts.search_index(fts.posting_lists(nodes, stems=True), nodes, query, 60, stems=True).collect()
    assert fts.search_index(index, nodes, "rights", 60, stems=True, bucketed=True).count() == 50
