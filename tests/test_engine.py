import json
import subprocess

import pytest
from codeloom.chunking.relations import PythonRelations
from codeloom.operators import graph
from codeloom.plans import telemetry
from codeloom.plans.engine import Engine, render, repository_id
from codeloom.plans.protocols import EmbeddingProvider, LocalModelProvider, SeededProvider
from codeloom.plans.store import Store
from codeloom.plans.tools import Tools
from codeloom.sources.repositories import Volume, repository_info
from codeloom.sources.tree import plan, read_tree, walk
from codeloom.streaming.ingest import ingest
from pyspark.sql import functions as F

FILES = {
    "pkg/__init__.py": "VERSION = 1\n",
    "pkg/service.py": "class Service:\n    def validate(self):\n        return True\n\n    def process(self):\n        return self.validate()\n" + "\n".join(f"def helper_{i}():\n    return 'needle haystack {i}'\n" for i in range(30)),
    "web/app.js": "app.get('/x', () => { return 1; });\n",
    "node_modules/skip.js": "nothing();\n",
    "bad.py": "def broken(:\n    pass\n",
    "binary.py": "a\0b",
    "notes.txt": "no code",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def indexed(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    return e, e.index(tree, "https://example.com/r.git", "c1")


def test_index_is_idempotent_and_locked(indexed, tree):
    e, s = indexed
    repo = repository_id("https://example.com/r.git")
    assert e.store.active(repo) == s and e.index(tree, "https://example.com/r.git", "c1") == s
    assert e.store.lock(repo) and e.index(tree, "https://example.com/r.git", "c2") == "queued"
    assert e.store.take_dirty(repo) and not e.store.take_dirty(repo)
    assert e.store.lock(repo, seconds=0) and not e.store.lock(repo)  # an old lock is taken over, once
    e.store.unlock(repo)
    e.store.take_dirty(repo)
    files = {r.path: r.parsing_status for r in e.store.read("files", s).collect()}
    assert files == {"pkg/__init__.py": "success", "pkg/service.py": "success", "web/app.js": "success", "bad.py": "success", "binary.py": "skipped"}


def test_failed_snapshot_is_not_visible(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    with pytest.raises(Exception):
        e.index(spark.createDataFrame([("a.py", 1)], "path string, size long"), "u", "c")
    assert e.store.active(repository_id("u")) is None and e.store.events(repository_id("u"))[-1]["status"] == "failed" and e.store.lock(repository_id("u"))


def test_retrieve_embed_and_reuse(indexed, tree):
    e, s = indexed
    provider = lambda texts: [[float(len(t) % 7 + 1), float(len(t) % 5), 1.0] for t in texts]
    hits = e.retrieve("needle haystack", url="https://example.com/r.git", strategy="keyword", limit=3).collect()
    assert hits and all("needle" in h.content for h in hits) and render(hits[0].asDict()).startswith("### pkg/service.py")
    broken = lambda texts: [[1.0]] * (len(texts) + 1) if any("haystack 7" in t for t in texts) else provider(texts)
    first = list(e.embed(None, broken, "m", batch=1, url="https://example.com/r.git"))
    assert [x["status"] for x in first] == ["init", "staging_start", "staging_progress", "staging_complete", "deduplicating", "deduplication_stats", "flushed_hits", "embedding_start", "embedding_progress", "completed"]
    assert 0 < first[-1]["failed"] < first[-1]["total_nodes"] and "ValueError" in first[-2]["errors"][0]
    last = list(e.embed(s, provider, "m"))[-1]
    assert last["newly_embedded"] == last["total_nodes"] == first[-1]["failed"]
    with pytest.raises(ValueError):
        list(e.embed(None, provider, "m", url="https://example.com/other"))
    again = e.index(tree, "https://example.com/r.git", "c9", force=True)
    assert list(e.embed(again, provider, "m"))[-1]["newly_embedded"] == 0
    both = e.retrieve("needle", snapshot=s, vector=[1.0, 1.0, 1.0], limit=4, filters={"path_prefix": "pkg"}).collect()
    assert len(both) == 4 and all(h.file_path.startswith("pkg") for h in both)
    assert e.retrieve("x", url="https://example.com/other") is None
    stems = e.retrieve("validating processes", snapshot=s, strategy="keyword").collect()
    assert stems and "validate" in stems[0].content
    assert e.retrieve('"needle haystack 3"', snapshot=s, strategy="keyword", limit=50).count() == 1
    assert e.retrieve('needle -"haystack 3"', snapshot=s, strategy="keyword", limit=50).filter("content like '%haystack 3\\'%'").count() == 0

    def down(texts):
        raise RuntimeError("no service")

    assert e.retrieve("needle", snapshot=s, provider=down, limit=2).filter("methods = 'keyword'").count() == 2  # the other search still answers
    assert e.retrieve("needle", snapshot=s, filters={"language": "go"}).count() == 0 and e.retrieve("needle", snapshot=s, filters={"language": "go"}, relax=True, limit=2).count() == 2
    with pytest.raises(ValueError):
        e.retrieve("x")


def test_read_and_navigate(indexed):
    e, s = indexed
    text = e.read_file(s, "pkg/service.py")["content"]
    assert text.replace("\n", "").replace(" ", "") == FILES["pkg/service.py"].replace("\n", "").replace(" ", "")
    with pytest.raises(FileNotFoundError):
        e.read_file(s, "none.py")
    assert [r.name for r in e.list_directory(s).collect()][:2] == ["pkg", "web"] and [r.path for r in e.find_directories(s, "PK").collect()] == ["pkg"]
    first = e.nodes(s).filter("file_path = 'pkg/service.py'").orderBy("start").first().node_id
    after = e.neighbour(s, first, "next")
    assert after and e.neighbour(s, after, "prev") == first
    assert e.dependencies(s, first) is None and e.stats()["files"] >= 5


def test_resolved_edges_make_a_call_tree(spark, indexed):
    e, s = indexed
    rel = spark.createDataFrame([(1, "web/app.js", 0, 5, "pkg/__init__.py", 0, 5, "calls", "VERSION", False)], "ref int, source_path string, source_start long, source_end long, target_path string, target_start long, target_end long, relation_type string, symbol string, external boolean")
    e.add_edges(s, rel)
    src = e.nodes(s).filter("file_path = 'web/app.js'").first().node_id
    assert e.call_tree(s, src).agg(F.max("depth")).first()[0] == 1
    target = e.nodes(s).filter("file_path = 'pkg/__init__.py'").first().node_id
    assert e.impact(s, target).first().symbol == "VERSION"


def test_plans_of_navigation_do_not_read_contents(indexed):
    e, s = indexed
    n = e.nodes(s)
    for df in (n, graph.parents(e.edges(s), n), graph.neighbours(n, "next")):
        assert "tables/contents" not in df._jdf.queryExecution().toString()
    hit = e.retrieve("needle", snapshot=s, strategy="keyword", limit=1)
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan


def test_a_pruned_snapshot_never_comes_back(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path))
    first = e.index(tree, "u", "c1")
    second = e.index(tree, "u", "c2", prune=True)
    third = e.index(tree, "u", "c1")
    assert len({first, second, third}) == 3 and e.nodes(third).count() > 0 and e.nodes(first).count() == 0
    status = {r.id: r.status for r in e.store.snapshots().collect()}
    assert status == {first: "pruned", second: "completed", third: "completed"}
    assert json.loads(e.store.snapshots().filter("status = 'completed'").first().stats)["files"] == 5


def test_repositories_keep_their_id(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.store.register("r1", "u", "main", "old")
    made = e.store.repositories().first().created_at
    e.store.register("r1", "u", "main", "new")
    e.store.register("r2", "u", "dev", "new")
    assert [(r.id, r.branch, r.name) for r in e.store.repositories().collect()] == [("r2", "dev", "new"), ("r1", "main", "new")]
    assert e.store.repositories().filter("id = 'r1'").first().created_at == made


def test_relations_subgraphs_and_tools(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    body = "\n".join(f"    x{i} = {i}" for i in range(120))
    (root / "a.py").write_text(f"import os\nfrom b import helper\n\ndef caller():\n{body}\n    return helper(os.getcwd())\n\nif True:\n    def inner():\n        return caller()\n")
    (root / "b.py").write_text(f"def helper(x):\n{body}\n    return x\n")
    e = Engine(spark, str(tmp_path / "store"))
    s = e.index(str(root), "https://example.com/t.git", "c1", relations=PythonRelations())
    edges = {(r.relation_type, r.symbol) for r in e.edges(s).filter("relation_type <> 'child_of'").collect()}
    assert {("imports", "os"), ("calls", "helper"), ("calls", "caller")} <= edges
    n = e.nodes(s)
    helper = n.filter("file_path = 'b.py'").orderBy("start").first().node_id
    nodes, links = e.subgraph(s, helper, "impact")
    assert {r.type for r in nodes.collect()} == {"center", "impact"} and links.filter("relation = 'calls'").count() >= 1
    caller = e.edges(s).filter("symbol = 'helper' and relation_type = 'calls'").first().source_id
    assert helper in {r.node_id for r in e.subgraph(s, caller, "pipeline")[0].collect()}
    assert {r.type for r in e.subgraph(s, caller, "neighbour")[0].collect()} >= {"center", "neighbour"}
    assert e.subgraph(s, helper, "parent")[0].count() >= 1
    with pytest.raises(ValueError):
        e.subgraph(s, helper, "other")
    assert graph.external_nodes(e.edges(s), n).filter("node_id = 'os'").count() == 1
    source = e.edges(s).filter("symbol = 'os' and relation_type = 'imports'").first().source_id
    found = graph.outgoing(e.edges(s).filter(F.col("source_id") == source), graph.with_external(e.edges(s), n))
    assert found.filter("target_id = 'os' and file = 'os' and line is null").count() == 1
    t = Tools(e, "https://example.com/t.git")
    assert "a.py" in t.search_codebase("getcwd") and "without them" in t.search_codebase("helper", {"language": "go"})
    assert t.read_file("b.py", 1, 1).splitlines()[1].startswith("def helper") and t.read_file("none.py").startswith("Error")
    assert "Called by" in t.inspect_node(helper) and t.list_repo_structure() == "a.py\nb.py"
    assert Tools(e, "https://example.com/none").search_codebase("x").startswith("Error")
    about = e.file_with_chunks(s, "b.py")
    assert about["chunks"][0]["start"] == 0 and about["content"].startswith("def helper")
    assert e.metadata(s, caller)["next"] is not None


def test_providers_and_telemetry(spark):
    p = SeededProvider("text-embedding-3-large")
    assert isinstance(p, EmbeddingProvider) and len(p(["a"])[0]) == 3072 and p(["a"]) == p(["a"]) != p(["b"])
    made = []
    local = LocalModelProvider("m", lambda: made.append(1) or (lambda texts: [[float(len(t))] for t in texts]), 1)
    assert local(["ab", " "]) == [[2.0], [5.0]] and local(["x"]) == [[1.0]] and made == [1]
    with pytest.raises(ValueError):
        LocalModelProvider("m", None, 2)(["x"])
    seen = []
    telemetry.HOOKS.append(lambda *a: seen.append(a))
    with pytest.raises(KeyError), telemetry.span(spark, "step", at=1):
        raise KeyError
    telemetry.HOOKS.clear()
    assert seen[0][0] == "step" and seen[0][2] == {"at": 1} and isinstance(seen[0][3], KeyError)


def test_older_store_is_migrated(spark, tmp_path):
    old = [("a" * 64, "text a"), ("b" * 64, "text b")]
    spark.createDataFrame(old, "chunk_hash string, content string").write.parquet(str(tmp_path / "tables/contents"))
    s = Store(spark, str(tmp_path))
    assert s.migrate() == 1 and s.migrate() == 2
    assert sorted(map(tuple, s.contents().collect())) == old and s.contents(["b" * 64]).count() == 1
    (tmp_path / "version").unlink()
    (tmp_path / ".version.crc").unlink(missing_ok=True)
    s._create("version", "9")
    with pytest.raises(ValueError):
        s.migrate()


def test_tree_is_planned_by_folders(spark, tree):
    assert sorted(walk(tree)) == sorted(p for p in FILES if not p.startswith("node_modules") and not p.endswith(".txt"))
    for least in (1, 2, 256):
        folders, files = plan(tree, least)
        assert sorted([*files, *(p for f in folders for p in walk(tree, f))]) == sorted(walk(tree))
    assert {r.path for r in read_tree(spark, tree).collect()} == set(walk(tree))


def test_streaming_ingest_adds_each_file_once(spark, tmp_path):
    rows = [("a.py", 6, b"x = 1\n", None), ("b.py", 6, b"y = 2\n", None)]
    spark.createDataFrame(rows, "path string, size long, content binary, error string").write.parquet(str(tmp_path / "landing"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "landing"), str(tmp_path / "store"), str(tmp_path / "ck"), "s").awaitTermination()
    e = Engine(spark, str(tmp_path / "store"))
    assert e.stats()["files"] == 2 and e.nodes(e.store.active("s")).count() == 2


def test_git_volume(tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=repo, check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (repo / "a.py").write_text("x = 1\n")
    run("add", ".")
    run("commit", "-qm", "one")
    v = Volume(str(tmp_path / "volume"))
    v.update(str(repo))
    first = v.head(str(repo))
    with v.checkout(str(repo), first) as folder:
        assert json.dumps(open(f"{folder}/a.py").read()) == '"x = 1\\n"'
    (repo / "b.py").write_text("y = 1\n")
    run("add", ".")
    run("commit", "-qm", "two")
    v.update(str(repo))
    assert v.changed_files(str(repo), first) == ["b.py"] and v.changed_files(str(repo), None) == []
    with pytest.raises(ValueError):
        v.head(str(repo), "none")
    assert v.remove_orphans() == [] and repository_info(str(repo))["branch"] == "main"
