"""The code graph's tables, made from the driver's test tables.

Documents stand for the files of one repository per source, in two snapshots:
``s1`` has the even ids, ``s2`` all. Their hard-split chunks are nodes, roles and
types follow from ids, and relations between neighbouring ids are edges. The same
definitions in DuckDB's SQL are in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.columns import category_of, label_of, search_tags, stable_id
from ..operators.chunks import first_in_file, hard_split
from ..operators.fts import posting_lists
from .scratch import kept, kept_path

ROLES = ("entry_point", "api_endpoint", "test_case", "class", "function")
EXTENSIONS = (".py", ".js", ".md", ".json", ".txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, lang, source, path`` of the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 5 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 7 == 0, "tests").otherwise("src")
    return d.withColumn("path", F.concat("source", F.lit("/"), folder, F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext))


def files(spark: SparkSession, sf_dir: str, snapshot: str = "s2") -> DataFrame:
    """``doc_id, file_id, snapshot_id, source, path, language, file_hash, size_bytes, category`` of a snapshot."""
    d = documents(spark, sf_dir)
    d = d.filter("doc_id % 2 = 0") if snapshot == "s1" else d
    return d.select(
        "doc_id", stable_id(F.lit(snapshot), F.col("path")).alias("file_id"), F.lit(snapshot).alias("snapshot_id"), "source", "path", F.col("lang").alias("language"),
        F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("size_bytes"), category_of(F.col("path")).alias("category"),
    )


def nodes(spark: SparkSession, sf_dir: str, snapshot: str = "s2", content: bool = True) -> DataFrame:
    """``node_id, doc_id, seq, file_id, file_path, language, category, start, end, start_line, end_line, chunk_hash, matches, tags`` and ``content`` of all chunks; chunked once per application."""
    out = kept(spark, f"{sf_dir}/documents.parquet", f"nodes-{snapshot}", lambda: _nodes(spark, sf_dir, snapshot))
    return out if content else out.drop("content")


def _nodes(spark: SparkSession, sf_dir: str, snapshot: str) -> DataFrame:
    d = documents(spark, sf_dir)
    d = d.filter("doc_id % 2 = 0") if snapshot == "s1" else d
    path = F.col("path")
    d = d.select("doc_id", stable_id(F.lit(snapshot), path).alias("file_id"), path.alias("file_path"), F.col("lang").alias("language"), category_of(path).alias("category"), "text")
    made = hard_split(d, ["doc_id", "file_id", "file_path", "language", "category"], "text")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("seq") % 2 == 0, "function").otherwise("class")
    match = lambda c, v: F.struct(F.lit(c).alias("category"), v.alias("value"), label_of(v).alias("label"))
    matches = F.when(F.col("doc_id") % 11 != 0, F.array(match("type", kind), match("role", role))).cast(schema.MATCHES)
    out = made.withColumn("node_id", stable_id(F.col("file_id"), F.col("start").cast("string"), F.col("end").cast("string"))).withColumn("chunk_hash", F.sha2("content", 256)).withColumn("matches", matches)
    return out.withColumn("tags", F.coalesce(search_tags(F.col("matches")), F.lit("")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_id, target_id, relation_type, symbol``: fragments to their file's first one, and relations between documents' chunks; derived once per application."""
    return kept(spark, f"{sf_dir}/documents.parquet", "edges", lambda: _edges(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir, content=False).select("node_id", "doc_id", "seq", "file_id")
    first = n.withColumn("first", first_in_file("node_id", "file_id", "seq"))
    child = first.filter("node_id <> first").select(F.col("node_id").alias("source_id"), F.col("first").alias("target_id"), F.lit("child_of").alias("relation_type"), F.lit(None).cast("string").alias("symbol"))
    target = n.filter("seq = 1").select(F.col("doc_id").alias("target_doc"), F.col("node_id").alias("target_id"))
    rules = [
        ("calls", F.col("doc_id") * 2, F.lit(True), F.concat(F.lit("fn_"), (F.col("doc_id") % 13).cast("string"))),
        ("calls", F.col("doc_id") + 1, F.col("seq") == 1, F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("fn_"), (F.col("doc_id") % 7).cast("string")))),
        ("imports", F.col("doc_id") + 3, F.col("seq") == 1, F.lit("mod")),
        ("references", F.col("doc_id") + 5, F.col("seq") == 2, F.lit("ref")),
        ("instantiates", F.col("doc_id") + 10, (F.col("seq") == 1) & (F.col("doc_id") % 4 == 0), F.lit("New")),
    ]
    rows = [n.filter(when).select(F.col("node_id").alias("source_id"), to.alias("target_doc"), F.lit(kind).alias("relation_type"), symbol.alias("symbol")) for kind, to, when, symbol in rules]
    related = rows[0]
    for r in rows[1:]:
        related = related.unionByName(r)
    related = related.join(target, "target_doc").filter("source_id <> target_id").select("source_id", "target_id", "relation_type", "symbol")
    return child.unionByName(related)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, embedding, node_id, file_path, language, category``: the vector of each document's first chunk."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    n = nodes(spark, sf_dir, content=False).filter("seq = 1").select(F.col("doc_id").alias("id"), "node_id", "file_path", "language", "category", "matches")
    return e.join(n, "id")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repository, snapshot, commit, status, seq``: a lifecycle log from the events of users."""
    names = {"signup": "pending", "view": "indexing", "click": "indexing", "purchase": "completed", "error": "failed"}
    status = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("repository"), F.col("event_id").alias("snapshot"), (F.col("event_id") % 3).alias("commit"), status.alias("status"), F.col("event_id").alias("seq"))


def engine(spark: SparkSession, sf_dir: str):  # noqa: ANN201 - plans import this module
    """The engine over a store that has these tables as snapshot ``s2``; written once per application."""
    from ..plans.engine import Engine

    root = kept_path(spark, f"{sf_dir}/documents.parquet", "store", lambda path: _store(spark, sf_dir, Engine(spark, path).store))
    return Engine(spark, root)


def _store(spark: SparkSession, sf_dir: str, store) -> None:  # noqa: ANN001
    n = nodes(spark, sf_dir)
    s = F.lit("s2").alias("snapshot_id")
    none = F.lit(None).cast("string")
    f = files(spark, sf_dir).select(F.col("file_id").alias("id"), "snapshot_id", "path", "file_hash", "language", "category", "size_bytes", F.lit("success").alias("parsing_status"), none.alias("parsing_error"))
    store.write("files", f)
    store.write("nodes", n.select(F.col("node_id").alias("id"), "file_id", s, "file_path", "chunk_hash", "start_line", "end_line", F.col("start").alias("byte_start"), F.col("end").alias("byte_end"), "matches", F.array().cast("array<string>").alias("tags")))
    store.write("edges", edges(spark, sf_dir).withColumn("snapshot_id", F.lit("s2")))
    store.write("posting_lists", posting_lists(n, stems=True).withColumn("snapshot_id", F.lit("s2")))
    store.add_contents(n.select("chunk_hash", "content"))
    e = embeddings(spark, sf_dir)
    store.write("embeddings", e.select(F.col("id").cast("string").alias("id"), F.col("node_id").alias("chunk_id"), s, none.alias("vector_hash"), F.lit("model-1").alias("model_name"), "file_path", "language", "category", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("embedding").cast("array<float>").alias("embedding")))
