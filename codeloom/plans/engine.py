"""The engine's facade: index a tree, embed its nodes, retrieve, navigate and read."""

from __future__ import annotations

import hashlib
import logging
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..chunking.files import parse_files, tables
from ..chunking.rules import Rules
from ..functions.columns import distinct_labels, primary_label, search_tags
from ..operators import embedding, fts, fusion, graph, lifecycle, reader, vectors
from ..operators.filters import build_predicate
from ..sources.tree import read_tree
from .protocols import MetadataProvider, RelationExtractor
from .store import Store
from .telemetry import span

COLUMNS = {"path": "file_path", "language": "language", "category": "category", "matches": "matches"}
LOG = logging.getLogger(__name__)


def repository_id(url: str, branch: str = "main") -> str:
    return hashlib.sha256(f"{url}|{branch}".encode()).hexdigest()


class Engine:
    """Everything over one store; ``rules`` (see ``chunking.rules``) add captures to what is indexed."""

    def __init__(self, spark: SparkSession, root: str, rules: Rules | None = None):
        self.spark, self.rules = spark, rules
        self.store = Store(spark, root)
        self.store.migrate()
        self._manifests: dict[str, DataFrame] = {}

    # writing

    def index(self, tree: str | DataFrame, url: str, commit: str, branch: str = "main", force: bool = False, prune: bool = False, name: str | None = None, relations: RelationExtractor | None = None) -> str:
        """Index a folder (or its ``path, size, content, error`` rows) as a snapshot; its id.

        A commit that is indexed already gives its snapshot, unless ``force``. ``queued`` means that
        another caller is indexing the repository: it runs again when it is done. A failed
        snapshot is never visible. ``relations`` makes edges from the files.
        """
        repo = repository_id(url, branch)
        self.store.register(repo, url, branch, name or url.rstrip("/").rpartition("/")[2].removesuffix(".git"))
        if not force and (known := self.store.completed(repo, commit)):
            return known
        if not self.store.lock(repo):
            return "queued"
        try:
            while True:
                before = self.store.active(repo)
                snapshot = uuid.uuid4().hex
                self.store.log(repo, snapshot, commit, "indexing")
                try:
                    with span(self.spark, "index", snapshot=snapshot):
                        stats = self._write(tree, snapshot, relations)
                except Exception as e:
                    self.store.log(repo, snapshot, commit, "failed", error=str(e)[:500])
                    raise
                self.store.activate(repo, snapshot, commit, stats)
                if prune and before:
                    self.store.prune(repo, before)
                if not self.store.take_dirty(repo):
                    return snapshot
        finally:
            self.store.unlock(repo)

    def index_from(self, provider: MetadataProvider, tree: str, **more: object) -> str:
        """Index a folder under the url, commit, branch and name that ``provider`` tells of it."""
        about = provider.metadata(tree)
        return self.index(tree, about["url"], about["commit"], about["branch"], name=about["name"], **more)

    def _write(self, tree: str | DataFrame, snapshot: str, relations: RelationExtractor | None) -> dict:
        rows = read_tree(self.spark, tree) if isinstance(tree, str) else tree
        # parsed once; Parquet, so that a lost executor costs nothing that later steps need
        path = f"{self.store.root}/staging/{snapshot}"
        parse_files(rows, self.rules).write.mode("overwrite").parquet(path)
        parsed = self.spark.read.parquet(path)
        made = tables(parsed, snapshot)
        self.store.add_contents(made.pop("contents"))
        for name, df in made.items():
            self.store.write(name, df)
        if relations is not None:
            self.add_edges(snapshot, relations.extract(rows))
        stats = parsed.groupBy("path").agg(F.max("status").alias("s"), F.count("seq").alias("n")).agg(
            F.count(F.lit(1)).alias("files"), F.sum("n").alias("nodes"), F.count_if(F.col("s") == "skipped").alias("skipped"), F.count_if(F.col("s") == "failed").alias("failed"),
        ).first().asDict()
        self.store._fs.delete(self.store._path(f"staging/{snapshot}"), True)
        return {k: v or 0 for k, v in stats.items()}

    def add_edges(self, snapshot: str, relations: DataFrame) -> None:
        """Resolve relations between byte ranges (see ``graph.resolve_edges``) and store them."""
        self.store.write("edges", graph.resolve_edges(relations, self.nodes(snapshot)).withColumn("snapshot_id", F.lit(snapshot)))

    def embed(self, snapshot: str | None, provider: Callable[[list[str]], list[list[float]]], model: str, batch: int = 100, url: str | None = None, branch: str = "main") -> Iterator[dict]:
        """Embed the nodes of a snapshot, or of the active one of ``url``; vectors of equal content are taken from all snapshots.

        Yields statuses, the last with counts. Nodes that have a vector of the model already are left alone. A batch of
        texts that fails is counted as ``failed``, and a later call embeds it; ``ValueError`` if there is no snapshot.
        """
        at = self.resolve(url, branch, snapshot)
        if at is None:
            raise ValueError(f"{url} has no active snapshot")
        yield {"status": "init", "snapshot": at, "model": model}
        todo = embedding.nodes_to_embed(self.nodes(at, content=True), self.store.read("embeddings", at), model)
        yield {"status": "staging_start"}
        path = f"{self.store.root}/staging/embed-{at}-{uuid.uuid4().hex[:8]}"
        staged = embedding.stage(todo, self.edges(at), model).select("node_id", "file_path", "language", "category", "start_line", "end_line", "prompt", "vector_hash", "model_name")
        staged.write.parquet(f"{path}/staged")
        staged = self.spark.read.parquet(f"{path}/staged")
        total = staged.count()
        yield {"status": "staging_progress", "staged": total}
        yield {"status": "staging_complete", "total": total}
        yield {"status": "deduplicating"}
        embedding.backfill(staged, self.store.read("embeddings")).write.parquet(f"{path}/filled")
        hits, missing = embedding.split_hits(self.spark.read.parquet(f"{path}/filled"))
        found = hits.count()
        yield {"status": "deduplication_stats", "recovered": found, "to_embed": total - found}
        self._store_vectors(hits, at)
        yield {"status": "flushed_hits", "count": found}
        yield {"status": "embedding_start", "total": total - found}
        with span(self.spark, "embed", snapshot=at):
            embedding.embed(missing, provider, batch).write.parquet(f"{path}/made")  # the provider is asked once
        made = self.spark.read.parquet(f"{path}/made")
        done = made.filter("embedding is not null")
        n = done.count()
        errors = [r.error for r in made.filter("error is not null").select("error").distinct().limit(5).collect()]
        yield {"status": "embedding_progress", "embedded": n, "failed": total - found - n, "errors": errors}
        self._store_vectors(done, at)
        self.store._fs.delete(self.store._path(path.removeprefix(f"{self.store.root}/")), True)
        yield {"status": "completed", "total_nodes": total, "recovered_from_history": found, "newly_embedded": n, "failed": total - found - n}

    def _store_vectors(self, rows: DataFrame, snapshot: str) -> None:
        """Append vectors whose id isn't stored yet."""
        new = rows.select(
            F.sha2(F.concat_ws("|", "node_id", "model_name"), 256).alias("id"), F.col("node_id").alias("chunk_id"), F.lit(snapshot).alias("snapshot_id"), "vector_hash", "model_name",
            "file_path", "language", "category", "start_line", "end_line", F.col("embedding").cast("array<float>").alias("embedding"),
        )
        self.store.write("embeddings", new.join(self.store.read("embeddings", snapshot).select("id"), "id", "left_anti"))

    # reading

    def nodes(self, snapshot: str, content: bool = False) -> DataFrame:
        """A snapshot's nodes with their file's language and category and their tags; with ``content`` also their text, for which all contents are joined."""
        rows = self._described(self._bare(snapshot), snapshot)
        return rows.join(self.store.contents(), "chunk_hash", "left").withColumn("content", F.coalesce("content", F.lit(""))) if content else rows

    def _bare(self, snapshot: str) -> DataFrame:
        """A snapshot's nodes as they are stored."""
        return self.store.read("nodes", snapshot).withColumnsRenamed({"id": "node_id", "byte_start": "start", "byte_end": "end", "tags": "syntax"})

    def _described(self, nodes: DataFrame, snapshot: str) -> DataFrame:
        """Nodes with their file's language and category and their tags."""
        f = self.store.read("files", snapshot).select(F.col("id").alias("file_id"), "language", "category")
        return nodes.join(f, "file_id").withColumn("tags", F.coalesce(search_tags(F.col("matches")), F.lit("")))

    def with_content(self, rows: DataFrame) -> DataFrame:
        """A bounded number of nodes (hits of a search, chunks of a file) with their text: only the contents asked for are read."""
        hashes = [r.chunk_hash for r in rows.select("chunk_hash").distinct().collect()]
        return rows.join(F.broadcast(self.store.contents(hashes)), "chunk_hash", "left").withColumn("content", F.coalesce("content", F.lit("")))

    def edges(self, snapshot: str) -> DataFrame:
        return self.store.read("edges", snapshot).drop("snapshot_id")

    def resolve(self, url: str | None, branch: str = "main", snapshot: str | None = None) -> str | None:
        """The snapshot asked for, or the repository's active one; ``ValueError`` without either name."""
        if snapshot is None and url is None:
            raise ValueError("a repository or a snapshot is needed")
        return snapshot or self.store.active(repository_id(url, branch))

    def retrieve(
        self, query: str, url: str | None = None, branch: str = "main", snapshot: str | None = None, limit: int = 10, strategy: str = "hybrid", filters: dict | None = None,
        vector: Sequence[float] | None = None, model: str | None = None, provider: Callable[[list[str]], list[list[float]]] | None = None, relax: bool = False,
    ) -> DataFrame | None:
        """The best nodes with labels, place, parent, neighbours and symbols; None without an active snapshot.

        ``strategy`` is ``keyword``, ``vector`` (which needs the query's ``vector`` or a ``provider`` that makes it) or ``hybrid``, which fuses twice
        as many hits of both and does without vectors if none is given. A search that fails is logged and finds nothing; the other one
        still answers. With ``relax`` a search with filters that finds nothing is tried once more without them.
        """
        if strategy not in ("hybrid", "vector", "keyword"):
            raise ValueError(f"unknown strategy {strategy!r}")
        if strategy == "vector" and vector is None and provider is None:
            raise ValueError("the vector strategy needs the query's vector")
        at = self.resolve(url, branch, snapshot)
        if at is None:
            return None
        n = self.nodes(at)
        where = build_predicate(filters, COLUMNS)
        depth = 2 * limit if strategy == "hybrid" else limit
        allowed = n.filter(where) if filters else self._bare(at)

        def near() -> DataFrame:
            v = vector if vector is not None else provider([query])[0]
            e = self.store.read("embeddings", at)
            e = (e if model is None else e.filter(F.col("model_name") == model)).select(F.col("chunk_id").alias("node_id"), "embedding")
            return vectors.knn(e.join(allowed.select("node_id"), "node_id", "left_semi") if filters else e, v, depth, id_col="node_id")

        def worded() -> DataFrame:
            q = fts.parse(query)
            phrases = any(len(p) > 1 for p in [*q.without, *(p for g in q.groups for p in g)])
            own = self.nodes(at, content=True).filter(where) if phrases else allowed
            return fts.search_index(self.store.read("posting_lists", at), own, query, depth, stems=True, bucketed=True)

        lists = []
        if strategy != "keyword" and (vector is not None or provider is not None):
            lists.append(("vector", self._tried("vector", at, near)))
        if strategy != "vector":
            lists.append(("keyword", self._tried("keyword", at, worded)))
        if relax and filters and not any(hits for _, hits in lists):
            return self.retrieve(query, snapshot=at, limit=limit, strategy=strategy, vector=vector, model=model, provider=provider)
        made = [(m, self.spark.createDataFrame([(r.node_id, r.score) for r in hits], "node_id string, score double")) for m, hits in lists]
        if strategy == "hybrid":
            best = fusion.fuse([fusion.ranked(hits, method, "node_id") for method, hits in made], limit).collect()
        else:
            best = [Row(id=r.node_id, score=r.score, methods=lists[0][0]) for r in lists[0][1]]
        return self._hydrate(self.spark.createDataFrame([(r.id, r.score, r.methods) for r in best], "id string, score double, methods string"), at)

    def _tried(self, method: str, snapshot: str, search: Callable[[], DataFrame]) -> list[Row]:
        """The hits of one search, a bounded list; none if it fails."""
        try:
            with span(self.spark, f"search {method}", snapshot=snapshot):
                return search().collect()
        except Exception:
            LOG.exception("%s search failed in snapshot %s", method, snapshot)
            return []

    def _hydrate(self, best: DataFrame, snapshot: str) -> DataFrame:
        ids = best.select(F.col("id").alias("node_id"))  # at most ``limit`` rows
        edges = self.edges(snapshot).join(F.broadcast(ids.withColumnRenamed("node_id", "source_id")), "source_id", "left_semi")
        n = self._described(F.broadcast(graph.around(edges, self._bare(snapshot), ids)), snapshot)  # few nodes; the rest of the snapshot isn't shuffled
        up = graph.parents(edges, n).select(F.col("node_id").alias("id"), "parent_id", F.col("line").alias("parent_line"))
        kind = n.select(F.col("node_id").alias("parent_id"), primary_label(F.col("matches")).alias("parent_label"))
        up = up.join(kind, "parent_id")
        sane = graph.outgoing(edges, graph.with_external(edges, n)).filter("symbol is not null and symbol not like '%<%' and symbol <> 'unknown'")
        inorder = F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "target_id", "symbol"))), lambda x: x["symbol"])
        calls = sane.groupBy(F.col("source_id").alias("id")).agg(F.slice(F.array_distinct(inorder), 1, 5).alias("outgoing"))
        label = n.select(F.col("node_id").alias("__at"), primary_label(F.col("matches")).alias("__label"))

        def side(w: str) -> DataFrame:
            found = graph.neighbours(n, w, ids).withColumnsRenamed({"node_id": "id", "neighbour_id": f"{w}_id"})
            return found.join(label, F.col(f"{w}_id") == F.col("__at")).drop("__at").withColumnRenamed("__label", f"{w}_label")

        own = self.with_content(n.join(F.broadcast(ids), "node_id", "left_semi"))
        rows = best.join(own.withColumnRenamed("node_id", "id"), "id").join(up, "id", "left").join(calls, "id", "left").join(side("next"), "id", "left").join(side("prev"), "id", "left")
        context = F.when(F.col("parent_line").isNotNull(), F.format_string("Inside %s defined in %s (L%d)", F.col("parent_label"), F.col("file_path"), F.col("parent_line")))
        return rows.select(
            "id", "score", "methods", "file_path", "language", "start_line", "end_line", "content", distinct_labels(F.col("matches")).alias("labels"), primary_label(F.col("matches")).alias("label"),
            context.alias("parent_context"), "parent_id", "parent_label", "next_id", "next_label", "prev_id", "prev_label", "outgoing",
        ).orderBy(F.desc("score"), "id")

    def _file(self, snapshot: str, path: str) -> tuple[DataFrame, DataFrame]:
        """A file's row and its nodes."""
        f = self.store.read("files", snapshot).filter(F.col("path") == path).withColumnRenamed("id", "file_id")
        return f, self.nodes(snapshot).filter(F.col("file_path") == path)

    def read_file(self, snapshot: str, path: str, start_line: int | None = None, end_line: int | None = None) -> dict:
        """Content of a file or of a range of its lines; ``FileNotFoundError`` if the snapshot doesn't have it."""
        f, n = self._file(snapshot, path)
        n = self.with_content(n)
        found = (reader.read_range(n, f, start_line, end_line) if start_line or end_line else reader.read_files(n, f)).first()
        if found is None:
            raise FileNotFoundError(path)
        return {"path": path, "content": found.content, "start_line": start_line or 1, "end_line": end_line or "EOF"}

    def file_with_chunks(self, snapshot: str, path: str) -> dict:
        """A file's content and the places of its chunks; ``FileNotFoundError`` if the snapshot doesn't have it."""
        f, n = self._file(snapshot, path)
        found = reader.overlay(self.with_content(n), f).first()
        if found is None:
            raise FileNotFoundError(path)
        return {"path": path, "content": found.content, "chunks": [c.asDict() for c in found.chunks or []]}

    def manifest(self, snapshot: str) -> DataFrame:
        """The tree of a snapshot's paths (see ``reader.file_tree``), made once for each engine."""
        if snapshot not in self._manifests:
            self._manifests[snapshot] = reader.file_tree(self.store.read("files", snapshot)).persist()
        return self._manifests[snapshot]

    def list_directory(self, snapshot: str, directory: str = "") -> DataFrame:
        return reader.list_directory(self.store.read("files", snapshot), directory)

    def find_directories(self, snapshot: str, part: str, limit: int = 10) -> DataFrame:
        return reader.find_directories(self.store.read("files", snapshot), part, limit)

    def neighbour(self, snapshot: str, node_id: str, direction: str) -> str | None:
        n = self.nodes(snapshot)
        found = graph.neighbours(n, direction, n.filter(F.col("node_id") == node_id)).first()
        return found and found.neighbour_id

    def parent(self, snapshot: str, node_id: str) -> str | None:
        found = graph.parents(self.edges(snapshot).filter(F.col("source_id") == node_id), self.nodes(snapshot)).first()
        return found and found.parent_id

    def metadata(self, snapshot: str, node_id: str) -> dict[str, dict | None]:
        """``next``, ``prev`` and ``parent`` of a node, each with its id and label, or None."""
        n = self.nodes(snapshot)
        ids = {w: self.neighbour(snapshot, node_id, w) for w in ("next", "prev")} | {"parent": self.parent(snapshot, node_id)}
        labels = {r.node_id: r.label for r in n.filter(F.col("node_id").isin([i for i in ids.values() if i])).select("node_id", primary_label(F.col("matches")).alias("label")).collect()}
        return {w: {"id": i, "label": labels.get(i)} if i else None for w, i in ids.items()}

    def impact(self, snapshot: str, node_id: str, limit: int = 20) -> DataFrame:
        """Who refers to a node."""
        return graph.incoming(self.edges(snapshot).filter(F.col("target_id") == node_id), self.nodes(snapshot), limit=limit)

    def dependencies(self, snapshot: str, node_id: str) -> DataFrame | None:
        """What a node refers to, phantom nodes of libraries included; None for a node without a parent."""
        if self.parent(snapshot, node_id) is None:
            return None
        edges = self.edges(snapshot).filter(F.col("source_id") == node_id)
        return graph.outgoing(edges, graph.with_external(edges, self.nodes(snapshot)))

    def call_tree(self, snapshot: str, node_id: str, max_depth: int = 2) -> DataFrame:
        n = self.nodes(snapshot)
        return graph.call_tree(self.edges(snapshot), n, n.filter(F.col("node_id") == node_id), max_depth)

    def subgraph(self, snapshot: str, node_id: str, kind: str) -> tuple[DataFrame, DataFrame]:
        """Nodes (``node_id, type``) and edges (``source, target, relation``) around a node: ``impact``, ``pipeline``, ``neighbour`` or ``parent``."""
        n, e = self.nodes(snapshot), self.edges(snapshot)
        at = n.filter(F.col("node_id") == node_id)
        made = {
            "impact": lambda: graph.impact_graph(e.filter(F.col("target_id") == node_id), n),
            "pipeline": lambda: graph.pipeline_graph(e, n, at),
            "neighbour": lambda: graph.neighbour_graph(e, n, at),
            "parent": lambda: graph.parent_graph(e.filter(F.col("source_id") == node_id), n),
        }
        if kind not in made:
            raise ValueError(f"unknown subgraph {kind!r}")
        links = made[kind]()
        center = at.select("node_id", F.lit("center").alias("type"))
        return center.unionByName(graph.subgraph_nodes(links, kind).select("node_id", "type")).distinct(), links.drop("center_id")

    def stats(self) -> dict[str, int]:
        """Rows of each table over all snapshots."""
        names = {n: self.store.read(n) for n in ("files", "nodes", "edges", "embeddings")} | {"contents": self.store.contents()}
        return {r["table"]: r.n for r in lifecycle.counts(names).collect()}


def render(hit: dict) -> str:
    """A hit as Markdown: where it is, its labels, code, up to five relations and its neighbours with their labels."""
    lines = [f"### {hit['file_path']} (L{hit['start_line']}-L{hit['end_line']})", f"Labels: {', '.join(hit['labels'])}"]
    lines += [hit["parent_context"]] if hit.get("parent_context") else []
    lines += [f"```{hit['language']}", hit["content"], "```"]
    calls = hit.get("outgoing") or []
    if calls:
        lines.append("Relations: " + ", ".join(calls[:5]) + (f" … ({len(calls) - 5} more)" if len(calls) > 5 else ""))
    lines += [f"{k}: {hit[f'{k}_id']}" + (f" ({hit[f'{k}_label']})" if hit.get(f"{k}_label") else "") for k in ("parent", "prev", "next") if hit.get(f"{k}_id")]
    return "\n".join(lines)
