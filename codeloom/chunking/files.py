"""Files to rows of the graph: one pass in Arrow batches, each file in one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LABELS, LANGUAGES, category_of, language_of, search_tags, stable_id
from ..operators.fts import posting_lists
from ..schema import MATCHES, NODES
from . import braces, python_ast
from .rules import Rules
from .units import Capture, Chunk, Chunker

PARSED = (
    "path string, status string, error string, file_hash string, size_bytes long, seq int, byte_start long, byte_end long, start_line int, end_line int, "
    "parent int, chunk_hash string, content string, matches array<struct<category: string, value: string, label: string>>, tags array<string>"
)


def label(value: str) -> str:
    return LABELS.get(value) or value.replace("_", " ").title()


def skipped(data: bytes) -> str | None:
    """Why a file isn't parsed: binary, minified or generated."""
    if b"\0" in data[:1024]:
        return "Binary file detected"
    if any(len(line) > 1000 for line in data[:2048].split(b"\n")[:5]):
        return "Minified"
    head = data[:500].lower()
    return "Generated" if any(x in head for x in (b"generated by", b"auto-generated", b"do not edit")) else None


def chunks_of(data: bytes, language: str, rules: Rules | None = None) -> tuple[list[Chunk], list[Capture]]:
    """The chunks and captures of a file; one that doesn't parse is split by size."""
    try:
        units, captures = (python_ast if language == "python" else braces).parse(data, (rules or {}).get(language))
    except (SyntaxError, ValueError, RecursionError):
        units, captures = [], []
    return Chunker(data).run(units), captures


def rows_of(path: str, data: bytes | None, size: int, error: str | None, rules: Rules | None = None) -> list[dict]:
    """The rows of a file: one for each chunk, or one without a chunk if it was skipped or is blank."""
    extension = path.rpartition(".")[2]
    if extension not in LANGUAGES:
        return []
    error = error or skipped(data)
    if error:
        return [{"path": path, "status": "skipped", "error": error, "file_hash": "", "size_bytes": 0}]
    about = {"path": path, "status": "success", "error": None, "file_hash": hashlib.sha256(data).hexdigest(), "size_bytes": size}
    chunks, captures = chunks_of(data, LANGUAGES[extension], rules)
    rows = []
    for i, c in enumerate(chunks):
        text = data[c.start : c.end].decode("utf-8", "ignore")
        first = data.count(b"\n", 0, c.start) + 1
        inside = [m for m in captures if (c.start <= m.start and m.end <= c.end) or (m.start <= c.start and c.end <= m.end)]
        found = list({(m.category, m.value): {"category": m.category, "value": m.value, "label": label(m.value)} for m in inside}.values())
        rows.append(about | {"seq": i, "byte_start": c.start, "byte_end": c.end, "start_line": first, "end_line": first + text.count("\n"), "parent": c.parent, "chunk_hash": hashlib.sha256(text.encode()).hexdigest(), "content": text, "matches": found, "tags": c.tags})
    return rows or [about]


_TEXT = pa.string()
_ARROW = pa.schema({
    "path": _TEXT, "status": _TEXT, "error": _TEXT, "file_hash": _TEXT, "size_bytes": pa.int64(), "seq": pa.int32(), "byte_start": pa.int64(), "byte_end": pa.int64(), "start_line": pa.int32(), "end_line": pa.int32(),
    "parent": pa.int32(), "chunk_hash": _TEXT, "content": _TEXT, "matches": pa.list_(pa.struct({"category": _TEXT, "value": _TEXT, "label": _TEXT})), "tags": pa.list_(_TEXT),
})


def parse_files(tree: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Rows of all chunks (``PARSED``) of ``path, size, content, error``; a file whose chunking fails has status ``failed``. ``rules`` add captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for i in range(batch.num_rows):
                path, size, content, error = (batch.column(c)[i].as_py() for c in range(4))
                try:
                    rows += rows_of(path, content, int(size), error, rules)
                except Exception as e:  # noqa: BLE001 - one bad file must not fail the snapshot
                    rows.append({"path": path, "status": "failed", "error": str(e), "file_hash": "", "size_bytes": 0})
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return tree.select("path", "size", "content", "error").mapInArrow(run, PARSED)


def tables(parsed: DataFrame, snapshot: str) -> dict[str, DataFrame]:
    """The tables ``files, nodes, contents, edges, posting_lists`` of a snapshot from ``parse_files``, whose rows should be stored, as each table reads them."""
    sid = F.lit(snapshot)
    rows = parsed.withColumn("snapshot_id", sid).withColumn("file_id", stable_id(sid, F.col("path")))
    node_id = lambda start, end: stable_id(F.col("file_id"), start.cast("string"), end.cast("string"))
    chunks = rows.filter("seq is not null").withColumn("id", node_id(F.col("byte_start"), F.col("byte_end")))
    files = rows.select(F.col("file_id").alias("id"), "snapshot_id", "path", "file_hash", language_of(F.col("path")).alias("language"), category_of(F.col("path")).alias("category"), "size_bytes", F.col("status").alias("parsing_status"), F.col("error").alias("parsing_error")).distinct()
    nodes = chunks.withColumn("file_path", F.col("path")).withColumn("matches", F.col("matches").cast(MATCHES)).select(*NODES.fieldNames())
    up = chunks.select("file_id", F.col("seq").alias("parent"), F.col("id").alias("target_id"))
    edges = chunks.join(up, ["file_id", "parent"]).select(F.col("id").alias("source_id"), "target_id", F.lit("child_of").alias("relation_type"), F.lit(None).cast("string").alias("symbol"), "snapshot_id")
    words = posting_lists(chunks.select(F.col("id").alias("node_id"), F.coalesce(search_tags(F.col("matches")), F.lit("")).alias("tags"), "content"), stems=True).withColumn("snapshot_id", sid)
    return {"files": files, "nodes": nodes, "contents": chunks.select("chunk_hash", "content"), "edges": edges, "posting_lists": words}
