"""The model of ``sources/corpus.py`` in DuckDB's SQL, by named pieces."""

from __future__ import annotations

from ..operators.fts import STOP_WORDS

TITLE = "array_to_string(list_transform(string_split(replace({0}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
LABEL = (
    "CASE {0} WHEN 'entry_point' THEN 'Application Entry Point' WHEN 'api_endpoint' THEN 'API Endpoint' WHEN 'test_case' THEN 'Test Case' WHEN 'test_suite' THEN 'Test Suite' "
    "WHEN 'data_schema' THEN 'Data Schema' WHEN 'class' THEN 'Class Definition' WHEN 'function' THEN 'Function Definition' ELSE " + TITLE + " END"
)
CATEGORY = (
    "CASE WHEN regexp_matches(lower({0}), 'test|spec') THEN 'test' WHEN regexp_matches(lower({0}), '\\.(json|yaml|yml|env|toml|xml)$') THEN 'config' "
    "WHEN regexp_matches(lower({0}), '\\.(md|txt|rst)$') THEN 'docs' ELSE 'code' END"
)
NEWLINES = "(length({0}) - length(replace({0}, chr(10), '')))"
STOP = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"
TOKENS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]+'), lambda w: NOT list_contains(" + STOP + ", w))"
COSINE = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"
_NEXT = (
    "CASE WHEN length(text) - {0} <= 800 THEN length(text) WHEN instr(reverse(substring(text, {0} + 1, 800)), chr(10)) BETWEEN 1 AND 399 "
    "THEN {0} + 801 - instr(reverse(substring(text, {0} + 1, 800)), chr(10)) ELSE {0} + 800 END"
)

PIECES: dict[str, tuple[list[str], str]] = {
    "d": ([], """SELECT doc_id, coalesce(text, '') AS text, lang, source, source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests' ELSE 'src' END || '/' || lang || '/doc_' || doc_id
        || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.md' WHEN 3 THEN '.json' ELSE '.txt' END AS path FROM documents"""),
    "files": (["d"], f"""SELECT doc_id, sha256('s2|' || path) AS file_id, 's2' AS snapshot_id, source, path, lang AS language, sha256(text) AS file_hash,
        CAST(strlen(text) AS BIGINT) AS size_bytes, {CATEGORY.format('path')} AS category FROM d"""),
    "files1": (["d"], f"""SELECT doc_id, sha256('s1|' || path) AS file_id, 's1' AS snapshot_id, source, path, lang AS language, sha256(text) AS file_hash,
        CAST(strlen(text) AS BIGINT) AS size_bytes, {CATEGORY.format('path')} AS category FROM d WHERE doc_id % 2 = 0"""),
    "cut": (["d"], f"""SELECT doc_id, 1 AS seq, CAST(0 AS BIGINT) AS a, {_NEXT.format('0')} AS b FROM d WHERE text <> ''
        UNION ALL SELECT d.doc_id, seq + 1, b, {_NEXT.format('b')} FROM cut JOIN d USING (doc_id) WHERE b < length(text)"""),
    "n0": (["files", "cut"], f"""SELECT doc_id, seq, file_id, files.path AS file_path, language, category, a AS start, b AS "end",
        sha256(file_id || '|' || a || '|' || b) AS node_id, substring(text, a + 1, b - a) AS content,
        CAST(1 + {NEWLINES.format('substring(text, 1, a)')} AS INTEGER) AS start_line,
        CAST(1 + {NEWLINES.format('substring(text, 1, b)')} AS INTEGER) AS end_line,
        CASE doc_id % 5 WHEN 0 THEN 'entry_point' WHEN 1 THEN 'api_endpoint' WHEN 2 THEN 'test_case' WHEN 3 THEN 'class' ELSE 'function' END AS role,
        CASE WHEN seq % 2 = 0 THEN 'function' ELSE 'class' END AS kind
        FROM cut JOIN d USING (doc_id) JOIN files USING (doc_id)"""),
    "nodes": (["n0"], f"""SELECT *, sha256(content) AS chunk_hash, doc_id % 11 <> 0 AS has_matches,
        CASE WHEN doc_id % 11 <> 0 THEN array_to_string(list_sort(list_distinct(string_split(lower(role || ' ' || {LABEL.format('role')} || ' ' || kind || ' ' || {LABEL.format('kind')}), ' '))), ' ') ELSE '' END AS tags
        FROM n0 WHERE regexp_matches(content, '[^ \\t\\n\\r\\f\\v]')"""),
    "child": (["nodes"], """SELECT node_id AS source_id, first_value(node_id) OVER (PARTITION BY file_id ORDER BY seq) AS target_id, 'child_of' AS relation_type, CAST(NULL AS VARCHAR) AS symbol FROM nodes"""),
    "rules": (["nodes"], """SELECT node_id AS source_id, doc_id * 2 AS target_doc, 'calls' AS relation_type, 'fn_' || doc_id % 13 AS symbol FROM nodes
        UNION ALL SELECT node_id, doc_id + 1, 'calls', CASE WHEN doc_id % 3 <> 0 THEN 'fn_' || doc_id % 7 END FROM nodes WHERE seq = 1
        UNION ALL SELECT node_id, doc_id + 3, 'imports', 'mod' FROM nodes WHERE seq = 1
        UNION ALL SELECT node_id, doc_id + 5, 'references', 'ref' FROM nodes WHERE seq = 2
        UNION ALL SELECT node_id, doc_id + 10, 'instantiates', 'New' FROM nodes WHERE seq = 1 AND doc_id % 4 = 0"""),
    "edges": (["child", "rules"], """SELECT * FROM child WHERE source_id <> target_id
        UNION ALL SELECT source_id, t.node_id, relation_type, symbol FROM rules JOIN nodes t ON t.doc_id = target_doc AND t.seq = 1 WHERE source_id <> t.node_id"""),
    "emb": (["nodes"], """SELECT vec_id AS id, e.label, embedding, node_id, file_path, language, category, role, kind, has_matches FROM embeddings e JOIN nodes ON doc_id = vec_id AND seq = 1"""),
    "log": ([], """SELECT user_id AS repository, event_id AS snapshot, event_id % 3 AS "commit", event_id AS seq,
        CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'indexing' END AS status FROM events"""),
    "incoming": (["edges"], """SELECT * EXCLUDE n FROM (SELECT target_id, source_id, file_path AS file, start_line AS line, relation_type AS relation, symbol,
        row_number() OVER (PARTITION BY target_id ORDER BY file_path, start_line, source_id, relation_type, symbol NULLS FIRST) AS n
        FROM edges JOIN nodes ON node_id = source_id WHERE relation_type IN ('calls', 'references', 'imports', 'instantiates')) WHERE n <= 50"""),
    "outgoing": (["edges"], """SELECT * FROM (SELECT source_id, target_id, file_path AS file, start_line AS line, relation_type AS relation, symbol,
        row_number() OVER (PARTITION BY source_id ORDER BY file_path, start_line, target_id, relation_type, symbol NULLS FIRST) AS n
        FROM edges JOIN nodes ON node_id = target_id WHERE relation_type IN ('calls', 'instantiates', 'imports')) WHERE n <= 50"""),
    "parent": (["edges"], """SELECT source_id AS node_id, min(target_id) AS parent_id FROM edges WHERE relation_type = 'child_of' GROUP BY 1"""),
    "next": (["nodes"], """SELECT node_id, neighbour_id FROM (SELECT a.node_id, b.node_id AS neighbour_id, row_number() OVER (PARTITION BY a.node_id ORDER BY b.start_line, b.start, b.node_id) AS n
        FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND b.start_line >= a.end_line AND a.node_id <> b.node_id) WHERE n = 1"""),
    "prev": (["nodes"], """SELECT node_id, neighbour_id FROM (SELECT a.node_id, b.node_id AS neighbour_id, row_number() OVER (PARTITION BY a.node_id ORDER BY b.end_line DESC, b.start DESC, b.node_id DESC) AS n
        FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND b.end_line <= a.start_line AND a.node_id <> b.node_id) WHERE n = 1"""),
    "q": ([], "SELECT embedding AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)"),
}


def sql(body: str, *needs: str) -> str:
    """``body`` after the pieces that it needs, and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in PIECES[name][0]:
                add(x)
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PIECES[n][1]})" for n in order) + "\n" + body
