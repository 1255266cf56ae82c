"""Schemas of the code graph's tables, and the vocabularies of their string columns."""

from __future__ import annotations

from pyspark.sql import types as T

ROLES = ("entry_point", "api_endpoint", "test_case", "test_suite", "data_schema", "class", "function", "method", "module")
CATEGORIES = ("test", "config", "docs", "code", "logic", "definition")
INCOMING = ("calls", "references", "imports", "instantiates")
OUTGOING = ("calls", "instantiates", "imports")
CONTEXT = ("calls", "references")
PARENT = "child_of"

MATCH = T.StructType([T.StructField(c, T.StringType()) for c in ("category", "value", "label")])
MATCHES = T.ArrayType(MATCH)

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


REPOSITORIES = _table(id=_S, url=_S, branch=_S, name=_S, created_at=_TS, updated_at=_TS)
SNAPSHOTS = _table(id=_S, repository_id=_S, commit_hash=_S, status=_S, created_at=_TS, completed_at=_TS, stats=_S)
FILES = _table(id=_S, snapshot_id=_S, path=_S, file_hash=_S, language=_S, category=_S, size_bytes=_L, parsing_status=_S, parsing_error=_S)
NODES = _table(id=_S, file_id=_S, snapshot_id=_S, file_path=_S, chunk_hash=_S, start_line=_I, end_line=_I, byte_start=_L, byte_end=_L, matches=MATCHES, tags=T.ArrayType(_S))
CONTENTS = _table(chunk_hash=_S, content=_S, bucket=_S)
POSTING_LISTS = _table(segment=_L, term=_S, weight_class=_S, at=T.ArrayType(_I), tf=T.ArrayType(_I), ids=T.ArrayType(_S), snapshot_id=_S, bucket=_I)
#: Postings of older stores.
POSTINGS = _table(term=_S, weight_class=_S, node_id=_S, tf=_L, snapshot_id=_S, bucket=_I)
EDGES = _table(source_id=_S, target_id=_S, relation_type=_S, symbol=_S)
EMBEDDINGS = _table(id=_S, chunk_id=_S, snapshot_id=_S, vector_hash=_S, model_name=_S, file_path=_S, language=_S, category=_S, start_line=_I, end_line=_I, embedding=T.ArrayType(T.FloatType()))
#: A line of the lifecycle log.
EVENTS = _table(seq=_L, repository=_S, snapshot=_S, commit=_S, status=_S, at=T.DoubleType(), stats=_S, error=_S)
