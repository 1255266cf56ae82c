"""The registered queries over the reference tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..chunking.files import parse_files
from ..functions import columns as C
from ..operators import chunks, embedding, fts, fusion, graph, lifecycle, reader, vectors, writes
from ..operators.filters import build_predicate
from ..sources import corpus
from ..sources.scratch import kept
from .oracle import CATEGORY, COSINE, LABEL, NEWLINES, STOP, TOKENS, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FILTER_COLUMNS = {"path": "file_path", "language": "language", "category": "category", "matches": "matches"}
MODEL = "model-1"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return corpus.nodes(spark, d)


def _slim(spark: SparkSession, d: str) -> DataFrame:
    return corpus.nodes(spark, d, content=False)


# scans and scalar functions


@query(sql("SELECT file_id, path, language, file_hash, size_bytes FROM files", "files"))
def q_scan_files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).select("file_id", "path", "language", "file_hash", "size_bytes")


@query(sql("SELECT path, category FROM files", "files"))
def q_file_category(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).select("path", "category")


@query(sql("SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' ELSE 'unknown' END AS detected FROM files", "files"))
def q_language_map(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).select("path", C.language_of(F.col("path")).alias("detected"))


_SECRET_URL = "regexp_replace(url, '^https?://', 'https://user:pass@')"


@query(f"SELECT page_id, regexp_replace(string_split(rtrim(url || '.git', '/'), '/')[-1], '\\.git$', '') AS name FROM pages")
def q_repo_name(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "pages").select("page_id", C.repository_name(F.concat("url", F.lit(".git"))).alias("name"))


@query(f"""SELECT page_id, regexp_replace({_SECRET_URL}, '^(https?://|git@|ssh://)[^@]+@(.+)', '\\1\\2') AS clean,
  trim(replace(regexp_replace(regexp_replace(regexp_replace({_SECRET_URL}, '^(https?://|git@|ssh://)[^@]+@(.+)', '\\1\\2'), '^(https?://|ssh://|git@)', ''), '\\.git$', ''), ':', '/'), '/') AS normal,
  sha256(url) || '.git' AS cache_key, string_split({_SECRET_URL}, '@')[-1] AS loggable FROM pages""")
def q_url_normalize(spark: SparkSession, d: str) -> DataFrame:
    url = F.regexp_replace("url", "^https?://", "https://user:pass@")
    return corpus.table(spark, d, "pages").select("page_id", C.without_credentials(url).alias("clean"), C.normal_url(url).alias("normal"), C.cache_key(F.col("url")).alias("cache_key"), C.loggable_url(url).alias("loggable"))


@query(sql("""SELECT path, CASE WHEN len(list_filter(string_split(substring(text, 1, 2048), chr(10))[1:5], lambda x: strlen(x) > 1000)) > 0 THEN 'Minified'
  WHEN regexp_matches(lower(substring(text, 1, 500)), 'generated by|auto-generated|do not edit') THEN 'Generated' END AS reason FROM d""", "d"))
def q_skip_reason(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.documents(spark, d)
    return t.select("path", C.skip_reason(F.col("path"), F.octet_length("text"), F.col("text")).alias("reason"))


@query(sql("SELECT path, list_has_any(string_split(path, '/')[:-2], ['.git','node_modules','__pycache__','.venv','dist','build','target','vendor','tests']) AS pruned FROM files", "files"))
def q_pruned_dirs(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("path", "/")
    tests = F.array_contains(F.slice(parts, 1, F.size(parts) - 1), "tests")
    return corpus.files(spark, d).select("path", (C.in_pruned_dir(F.col("path")) | tests).alias("pruned"))


@query(sql("""SELECT p, NOT (list_has_any(string_split(p, '/')[:-2], ['.git','node_modules','__pycache__','.venv','dist','build','target','vendor'])
  OR len(list_filter(string_split(p, '/')[:-2], lambda x: starts_with(x, '.'))) > 0 OR starts_with(string_split(p, '/')[-1], '.') OR ends_with(p, '.lock')) AS processed
  FROM (SELECT CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN '.cache/' || path WHEN 2 THEN 'build/' || path ELSE path || '.lock' END AS p FROM files)""", "files"))
def q_should_process(spark: SparkSession, d: str) -> DataFrame:
    p, n = F.col("path"), F.col("doc_id") % 4
    made = F.when(n == 0, p).when(n == 1, F.concat(F.lit(".cache/"), p)).when(n == 2, F.concat(F.lit("build/"), p)).otherwise(F.concat(p, F.lit(".lock")))
    return corpus.files(spark, d).select(made.alias("p")).withColumn("processed", C.should_process(F.col("p")))


@query(f"""SELECT page_id, CASE WHEN trim(t) = '' THEN 'empty_node_content' ELSE t END AS cleaned, sha256(CASE WHEN trim(w) = '' THEN 'empty' ELSE w END) AS whole, md5(url) AS url_md5
  FROM (SELECT *, substring(w, 1, 25000) AS t FROM (SELECT *, CASE WHEN page_id % 50 = 0 THEN ' ' ELSE replace(html, chr(10), ' ') END AS w FROM pages))""")
def q_text_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """As one service takes texts, up to its limit, and as another one takes them whole."""
    html = F.when(F.col("page_id") % 50 == 0, "\n").otherwise(F.col("html"))
    return corpus.table(spark, d, "pages").select("page_id", C.cleaned_for_embedding(html).alias("cleaned"), F.sha2(C.cleaned_for_embedding(html, None, "empty"), 256).alias("whole"), F.md5("url").alias("url_md5"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.symbol'), 'unknown') AS symbol FROM events""")
def q_json_access(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.symbol"), F.lit("unknown")).alias("symbol"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE array_to_string(list_sort(json_keys(props)), ',') END AS keys, CASE WHEN event_id % 3 = 0 THEN 0 ELSE len(json_keys(props)) END AS n FROM events""")
def q_json_fallback(spark: SparkSession, d: str) -> DataFrame:
    """JSON that doesn't parse counts as an empty object."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return corpus.table(spark, d, "events").select("event_id", F.array_join(F.array_sort(keys), ",").alias("keys"), F.size(keys).cast("long").alias("n"))


# chunks


@query(sql("SELECT doc_id, seq, start, \"end\", content FROM nodes", "nodes"))
def q_hard_split(spark: SparkSession, d: str) -> DataFrame:
    return chunks.hard_split(corpus.documents(spark, d), ["doc_id"], "text").select("doc_id", "seq", "start", "end", "content")


@query(sql("SELECT doc_id, seq, start_line, end_line FROM nodes", "nodes"))
def q_chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return _slim(spark, d).select("doc_id", "seq", "start_line", "end_line")


@query(sql("SELECT source_id AS node_id, target_id AS first_id FROM child", "child"))
def q_chunk_parent(spark: SparkSession, d: str) -> DataFrame:
    return _slim(spark, d).select("node_id", chunks.first_in_file("node_id", "file_id", "seq").alias("first_id"))


@query(sql("""SELECT doc_id, start, delta, CASE WHEN delta > 0 THEN 'gap' ELSE 'overlap' END AS kind
  FROM (SELECT doc_id, start, start - coalesce(lag("end") OVER (PARTITION BY file_id ORDER BY start), 0) AS delta FROM nodes WHERE doc_id % 2 = 0 OR seq % 3 <> 0) WHERE delta <> 0""", "nodes"))
def q_coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    kept = _slim(spark, d).filter("doc_id % 2 = 0 or seq % 3 <> 0")
    return chunks.coverage_audit(kept, "file_id", "start", "end").select("doc_id", "start", "delta", "kind")


# writes


@query(sql("SELECT DISTINCT chunk_hash, content FROM nodes", "nodes"))
def q_cas_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("chunk_hash", "content").dropDuplicates(["chunk_hash"])


@query(sql("SELECT DISTINCT chunk_hash, content FROM nodes WHERE chunk_hash NOT IN (SELECT chunk_hash FROM nodes WHERE doc_id % 2 = 0)", "nodes"))
def q_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).select("doc_id", "chunk_hash", "content")
    return writes.insert_ignore(n.filter("doc_id % 2 = 0").select("chunk_hash", "content"), n.select("chunk_hash", "content"), ["chunk_hash"])


@query(sql("""SELECT path, coalesce(o.file_id, n.file_id) AS file_id, n.file_hash, coalesce(o.size_bytes, n.size_bytes + 1) AS size_bytes
  FROM files n LEFT JOIN files1 o USING (path)""", "files", "files1"))
def q_upsert_files(spark: SparkSession, d: str) -> DataFrame:
    cols = ["path", "file_id", "file_hash", "size_bytes"]
    new = corpus.files(spark, d).withColumn("size_bytes", F.col("size_bytes") + 1)
    return writes.upsert(corpus.files(spark, d, "s1").select(cols), new.select(cols), ["path"], ["file_hash"])


_REPOS = "SELECT source AS url, lang AS branch, CAST(min(doc_id) AS VARCHAR) AS id, '{0} ' || max(doc_id) AS name FROM d {1} GROUP BY 1, 2"


def _repos(spark: SparkSession, d: str, where: str, name: str) -> DataFrame:
    rows = corpus.documents(spark, d).filter(where).groupBy(F.col("source").alias("url"), F.col("lang").alias("branch"))
    return rows.agg(F.min("doc_id").cast("string").alias("id"), F.concat(F.lit(name + " "), F.max("doc_id").cast("string")).alias("name"))


@query(sql(f"SELECT n.url, n.branch, coalesce(o.id, n.id) AS id, n.name FROM ({_REPOS.format('new', '')}) n LEFT JOIN ({_REPOS.format('old', 'WHERE doc_id % 3 = 0')}) o ON o.url IS NOT DISTINCT FROM n.url AND o.branch IS NOT DISTINCT FROM n.branch", "d"))
def q_upsert_repo(spark: SparkSession, d: str) -> DataFrame:
    """A repository that is registered again by url and branch keeps its id and takes the new name."""
    return writes.upsert(_repos(spark, d, "doc_id % 3 = 0", "old"), _repos(spark, d, "true", "new"), ["url", "branch"], ["name"]).select("url", "branch", "id", "name")


@query(sql("SELECT url, branch, id, name FROM (SELECT *, row_number() OVER (ORDER BY url, branch) AS n FROM (" + _REPOS.format("new", "") + "))", "d"))
def q_list_repositories(spark: SparkSession, d: str) -> DataFrame:
    return _repos(spark, d, "true", "new").orderBy("url", "branch")


@query(sql("SELECT source AS name, arg_max(lang, doc_id) AS branch, arg_max(doc_id, doc_id) AS last FROM d GROUP BY 1", "d"))
def q_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.documents(spark, d).select(F.col("source").alias("name"), F.col("lang").alias("branch"), F.col("doc_id").alias("last"), F.col("doc_id").alias("seq"))
    return writes.replace_latest(rows, ["name"], "seq").select("name", "branch", "last")


@query(sql("SELECT file_id, path FROM files WHERE source NOT IN (SELECT min(source) FROM files)", "files"))
def q_prune_snapshot(spark: SparkSession, d: str) -> DataFrame:
    f = corpus.files(spark, d)
    first = f.agg(F.min("source").alias("source"))
    return writes.delete_cascade(first, {"files": f}, "source")["files"].select("file_id", "path")


@query(sql("SELECT DISTINCT chunk_hash FROM nodes WHERE chunk_hash NOT IN (SELECT chunk_hash FROM nodes WHERE doc_id % 3 <> 0)", "nodes"))
def q_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    n = _slim(spark, d)
    return writes.unreferenced(n.select("chunk_hash").distinct(), n.filter("doc_id % 3 <> 0"))


# filters


def _filtered(filters: dict, dialect: str = "graph") -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _slim(spark, d).filter(build_predicate(filters, FILTER_COLUMNS, dialect)).select("node_id")

    return run


for _name, _filters, _dialect, _where in [
    ("q_filter_path", {"path_prefix": ["src1/", "src2/tests"]}, "graph", "file_path LIKE 'src1%' OR file_path LIKE 'src2/tests%'"),
    ("q_filter_lang_in", {"language": ["de", "fr"]}, "graph", "language IN ('de', 'fr')"),
    ("q_filter_lang_not_in", {"exclude_language": ["en"]}, "graph", "language NOT IN ('en')"),
    ("q_filter_category", {"category": ["test", "config"]}, "graph", "category IN ('test', 'config')"),
    ("q_filter_not_category", {"exclude_category": "docs"}, "graph", "category NOT IN ('docs')"),
    ("q_filter_role", {"role": ["class", "test_case"]}, "graph", "has_matches AND role IN ('class', 'test_case')"),
    ("q_filter_not_role", {"exclude_role": ["class", "entry_point"]}, "graph", "has_matches AND role NOT IN ('class', 'entry_point')"),
    ("q_filter_combo", {"path_prefix": "src", "language": ["en", "es"], "exclude_role": ["function"], "category": ["code", "docs"]}, "graph", "file_path LIKE 'src%' AND language IN ('en', 'es') AND has_matches AND role <> 'function' AND category IN ('code', 'docs')"),
    ("q_filter_hybrid_dialect", {"path_prefix": "/src1/", "role": ["function"], "exclude_category": ["test"]}, "hybrid", "file_path LIKE 'src1%' AND has_matches AND (role = 'function' OR kind = 'function') AND category <> 'test'"),
]:
    QUERIES[_name] = _filtered(_filters, _dialect)
    ORACLES[_name] = sql(f"SELECT node_id FROM nodes WHERE {_where}", "nodes")


# keyword search

_TERMS = f"SELECT *, {TOKENS.format('tags')} AS ta, {TOKENS.format('content')} AS tb FROM nodes"


def _rank(words: list[str]) -> str:
    w = lambda x: f"(len(list_filter(ta, lambda t: t = '{x}')) * 1.0 + len(list_filter(tb, lambda t: t = '{x}')) * 0.4)"
    return "round(CAST(" + " + ".join(f"{w(x)} / (1 + {w(x)})" for x in words) + " AS DOUBLE), 6)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings, made once; each file is in order of terms."""
    return kept(spark, f"{d}/documents.parquet", "postings", lambda: fts.posting_lists(_nodes(spark, d)).sortWithinPartitions("term"))


def _fts(text: str, words: list[str], where: str, k: int = 50, indexed: bool = False) -> tuple[Query, str]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fts.search_index(_index(spark, d), _slim(spark, d), text, k) if indexed else fts.search(_nodes(spark, d), text, k)

    return run, sql(f"SELECT node_id, {_rank(words)} AS score FROM ({_TERMS}) WHERE {where} ORDER BY score DESC, node_id LIMIT {k}", "nodes")


_HAS = lambda w: f"list_contains(list_concat(ta, tb), '{w}')"
for _name, (_run, _sql) in {
    "q_fts_match_and": _fts("apache version", ["apache", "version"], f"{_HAS('apache')} AND {_HAS('version')}"),
    "q_fts_match_or": _fts("gnu or mit", ["gnu", "mit"], f"{_HAS('gnu')} OR {_HAS('mit')}"),
    "q_fts_not": _fts("license -apache", ["license"], f"{_HAS('license')} AND NOT {_HAS('apache')}"),
    "q_fts_phrase": _fts('"rights reserved"', ["reserved", "rights"], "contains(' ' || array_to_string(list_concat(ta, tb), ' ') || ' ', ' rights reserved ')"),
    "q_fts_rank_topk": _fts("class or definition", ["class", "definition"], f"{_HAS('class')} OR {_HAS('definition')}", 20, True),
}.items():
    QUERIES[_name], ORACLES[_name] = _run, _sql


@query(sql(f"""SELECT node_id, stage FROM (SELECT node_id, stage, min(stage) OVER () AS best FROM (SELECT node_id,
  CASE WHEN contains(' ' || array_to_string(t, ' ') || ' ', ' licensed license ') THEN 1 WHEN list_contains(t, 'licensed') AND list_contains(t, 'license') THEN 2
       WHEN list_contains(t, 'licensed') OR list_contains(t, 'license') THEN 3 END AS stage
  FROM (SELECT node_id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS t FROM nodes)) WHERE stage IS NOT NULL) WHERE stage = best""", "nodes"))
def q_fts_cascade(spark: SparkSession, d: str) -> DataFrame:
    return fts.cascade(_nodes(spark, d), "licensed license")


@query(sql(f"""SELECT term, weight_class, node_id, count(*) AS tf FROM (
  SELECT node_id, 'A' AS weight_class, unnest({TOKENS.format('tags')}) AS term FROM nodes UNION ALL SELECT node_id, 'B', unnest({TOKENS.format('content')}) FROM nodes) GROUP BY ALL""", "nodes"))
def q_fts_postings(spark: SparkSession, d: str) -> DataFrame:
    return fts.postings(_nodes(spark, d))


@query(sql(f"SELECT node_id, {_rank(['apache', 'license'])} AS score FROM ({_TERMS}) WHERE {_HAS('apache')} AND {_HAS('license')} ORDER BY score DESC, node_id LIMIT 50", "nodes"))
def q_fts_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best nodes by the inverted index, of which only the postings of the words are read."""
    return fts.search_index(_index(spark, d), _slim(spark, d), "apache license", 50)


@query(sql(f"""SELECT node_id, {_rank(['gnu', 'license', 'mit'])} AS score FROM ({_TERMS}) WHERE ({_HAS('mit')} OR {_HAS('gnu')}) AND {_HAS('license')} AND NOT {_HAS('apache')} ORDER BY score DESC, node_id LIMIT 50""", "nodes"))
def q_fts_index_boolean(spark: SparkSession, d: str) -> DataFrame:
    return fts.search_index(_index(spark, d), _slim(spark, d), "mit or gnu license -apache", 50)


@query(sql(f"""SELECT node_id, {_rank(['reserved', 'rights'])} AS score FROM ({_TERMS}) WHERE contains(' ' || array_to_string(list_concat(ta, tb), ' ') || ' ', ' rights reserved ')
  AND NOT contains(' ' || array_to_string(list_concat(ta, tb), ' ') || ' ', ' test case ') ORDER BY score DESC, node_id LIMIT 50""", "nodes"))
def q_fts_index_phrase(spark: SparkSession, d: str) -> DataFrame:
    return fts.search_index(_index(spark, d), _nodes(spark, d), '"rights reserved" -"test case"', 50)


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substring(lower(text), i, 3)))), '|') AS trigrams FROM benchmark""")
def q_trigram(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(fts.trigrams(F.col("text"))), "|").alias("trigrams"))


@query(sql("SELECT node_id FROM nodes WHERE contains(lower(file_path), 'cense') OR contains(lower(tags), 'cense') OR contains(lower(content), 'cense') ORDER BY node_id LIMIT 100", "nodes"))
def q_trigram_search(spark: SparkSession, d: str) -> DataFrame:
    return fts.trigram_search(_nodes(spark, d), "CenSe", 100)


_CASCADE = "list_concat(regexp_extract_all(lower(file_path), '[a-z0-9_]+'), [' '], regexp_extract_all(lower(tags), '[a-z0-9_]+'), [' '], regexp_extract_all(lower(content), '[a-z0-9_]+'), [' '])"


@query(sql(f"""SELECT node_id, stage, score FROM (SELECT node_id, stage, min(stage) OVER () AS best, score FROM (SELECT node_id, round(len(list_filter(t, lambda x: x IN ('class', 'definition'))) / (len(t) - 3), 6) AS score,
  CASE WHEN contains(' ' || array_to_string(t, ' ') || ' ', ' class definition ') THEN 1 WHEN list_contains(t, 'class') AND list_contains(t, 'definition') THEN 2
       WHEN list_contains(t, 'class') OR list_contains(t, 'definition') THEN 3 END AS stage FROM (SELECT node_id, {_CASCADE} AS t FROM nodes)) WHERE stage IS NOT NULL) WHERE stage = best ORDER BY score DESC, node_id LIMIT 40""", "nodes"))
def q_fts_cascade_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Phrase, all words or any word in path, tags and content, ranked and limited."""
    return fts.cascade(_nodes(spark, d), "class definition", columns=("file_path", "tags", "content"), k=40)


@query(sql("SELECT node_id, tags FROM nodes", "nodes"))
def q_search_doc_tags(spark: SparkSession, d: str) -> DataFrame:
    return _slim(spark, d).select("node_id", "tags")


@query(sql(f"""SELECT h.node_id, h.score, n.file_path, f.category, f.source AS repository, n.content FROM (SELECT node_id, {_rank(['license', 'mit'])} AS score FROM ({_TERMS}) WHERE {_HAS('mit')} OR {_HAS('license')} ORDER BY score DESC, node_id LIMIT 30) h
  JOIN nodes n USING (node_id) JOIN files f ON f.file_id = n.file_id""", "nodes"))
def q_search_joined(spark: SparkSession, d: str) -> DataFrame:
    """The hits of a keyword search with their node, text, file and repository: the top comes first, the joins are of 30 rows."""
    hits = F.broadcast(fts.search_index(_index(spark, d), _slim(spark, d), "mit or license", 30))  # 30 rows
    f = corpus.files(spark, d).select("file_id", "category", F.col("source").alias("repository"))
    return _nodes(spark, d).drop("category").join(hits, "node_id").join(f, "file_id").select("node_id", "score", "file_path", "category", "repository", "content")


@query(sql(f"""SELECT h.id, h.score, n.node_id, n.content, f.size_bytes, f.source AS repository FROM (SELECT id, round({COSINE.format('embedding', 'v')}, 6) AS score FROM emb, q ORDER BY score DESC, id LIMIT 30) h
  JOIN nodes n ON n.doc_id = h.id AND n.seq = 1 JOIN files f ON f.file_id = n.file_id""", "emb", "q"))
def q_knn_joined(spark: SparkSession, d: str) -> DataFrame:
    """The most similar vectors with their node, text and file."""
    hits = vectors.knn(corpus.embeddings(spark, d), _first_vector(spark, d), 30)
    f = corpus.files(spark, d).select("file_id", "size_bytes", F.col("source").alias("repository"))
    n = _nodes(spark, d).filter("seq = 1").withColumnRenamed("doc_id", "id")
    return n.join(F.broadcast(hits), "id").join(f, "file_id").select("id", "score", "node_id", "content", "size_bytes", "repository")  # 30 rows


# vectors and fusion


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    t = corpus.table(spark, d, "embeddings")
    return t.orderBy("vec_id").select("embedding").first()[0]


@query(sql(f"SELECT id, node_id, round({COSINE.format('embedding', 'v')}, 6) AS score FROM emb, q ORDER BY score DESC, id LIMIT 20", "emb", "q"))
def q_knn(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(corpus.embeddings(spark, d), _first_vector(spark, d), 20, keep=["node_id"])


@query(sql(f"SELECT id, round({COSINE.format('embedding', 'v')}, 6) AS score FROM emb, q WHERE language = 'en' AND category <> 'test' AND has_matches AND role IN ('class', 'function') ORDER BY score DESC, id LIMIT 20", "emb", "q"))
def q_knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = build_predicate({"language": "en", "exclude_category": "test", "role": ["class", "function"]}, FILTER_COLUMNS)
    return vectors.knn(corpus.embeddings(spark, d), _first_vector(spark, d), 20, where)


@query(f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({COSINE.format('a.embedding', 'b.embedding')}, 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE.format('a.embedding', 'b.embedding')}, 6) DESC, b.vec_id) AS rank
  FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5""")
def q_knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by 100 among all others."""
    t = corpus.table(spark, d, "embeddings")
    return vectors.knn_batch(t, t.filter("vec_id % 100 = 0"), 5, "vec_id")


#: All components of a vector in one exact number.
_CHECKSUM = "CAST(list_sum(list_transform({0}, lambda x, i: i * CAST(floor(1000000 * CAST(x AS DOUBLE)) AS BIGINT))) AS BIGINT)"


def _checksum(vector: str) -> Column:
    return F.aggregate(F.transform(vector, lambda x, i: (i + 1) * F.floor(x.cast("double") * 1_000_000)), F.lit(0).cast("long"), lambda s, x: s + x)


@query(f"SELECT label AS vector_hash, {_CHECKSUM.format('arg_min(embedding, vec_id)')} AS components FROM embeddings GROUP BY 1")
def q_vector_cache(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.table(spark, d, "embeddings")
    return vectors.first_vectors(t, "label", "vec_id").select(F.col("label").alias("vector_hash"), _checksum("embedding").alias("components"))


_VECTOR_HITS = f"SELECT node_id AS id, row_number() OVER (ORDER BY score DESC, node_id) - 1 AS rank, 'vector' AS method FROM (SELECT node_id, round({COSINE.format('embedding', 'v')}, 6) AS score FROM emb, q ORDER BY score DESC, node_id LIMIT 20)"
_KEYWORD_HITS = f"SELECT node_id AS id, row_number() OVER (ORDER BY score DESC, node_id) - 1 AS rank, 'keyword' AS method FROM (SELECT node_id, {_rank(['class', 'definition'])} AS score FROM ({_TERMS}) WHERE {_HAS('class')} OR {_HAS('definition')} ORDER BY score DESC, node_id LIMIT 20)"
_FUSED = f"""SELECT id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score, string_agg(method, '+' ORDER BY method) AS methods,
  min(CASE WHEN method = 'vector' THEN rank END) AS v, min(CASE WHEN method = 'keyword' THEN rank END) AS k FROM ({_VECTOR_HITS} UNION ALL {_KEYWORD_HITS}) GROUP BY id"""


def _hybrid(spark: SparkSession, d: str, limit: int = 10) -> DataFrame:
    hits = vectors.knn(corpus.embeddings(spark, d).select("node_id", "embedding"), _first_vector(spark, d), 2 * limit, id_col="node_id")
    words = fts.search_index(_index(spark, d), _slim(spark, d), "class or definition", 2 * limit)
    return fusion.fuse([fusion.ranked(hits, "vector", "node_id"), fusion.ranked(words, "keyword", "node_id")], limit)


@query("SELECT CAST(o.o_custkey AS BIGINT) AS id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score, string_agg(method, '+' ORDER BY method) AS methods FROM ("
       "SELECT o_custkey, row_number() OVER (ORDER BY s DESC, o_custkey) - 1 AS rank, 'vector' AS method FROM (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS s FROM orders GROUP BY 1 ORDER BY s DESC, o_custkey LIMIT 30) "
       "UNION ALL SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1, 'keyword' FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30)) o GROUP BY 1")
def q_rrf(spark: SparkSession, d: str) -> DataFrame:
    a = corpus.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(30)
    b = corpus.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")).orderBy(F.desc("score"), "id").limit(30)
    return fusion.fuse([fusion.ranked(a, "vector"), fusion.ranked(b, "keyword")], 60)


@query(sql(f"SELECT id, score, methods FROM ({_FUSED}) ORDER BY score DESC, v NULLS LAST, k NULLS LAST, id LIMIT 10", "emb", "q"))
def q_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)


@query(sql(f"""SELECT f.id, f.methods, n.file_path, n.start_line, n.content,
  CASE WHEN n.has_matches THEN array_to_string(list_sort(list_distinct([{LABEL.format('n.role')}, {LABEL.format('n.kind')}])), ', ') ELSE 'Code Block' END AS labels,
  'Inside block defined in ' || n.file_path || ' (L' || p2.start_line || ')' AS parent_context, x.neighbour_id AS next_id, y.neighbour_id AS prev_id
  FROM (SELECT * FROM ({_FUSED}) ORDER BY score DESC, v NULLS LAST, k NULLS LAST, id LIMIT 10) f JOIN nodes n ON n.node_id = f.id
  LEFT JOIN parent p ON p.node_id = f.id LEFT JOIN nodes p2 ON p2.node_id = p.parent_id LEFT JOIN next x ON x.node_id = f.id LEFT JOIN prev y ON y.node_id = f.id""", "emb", "q", "parent", "next", "prev"))
def q_hydrate(spark: SparkSession, d: str) -> DataFrame:
    best = _hybrid(spark, d).collect()  # ten rows; the searches run once
    hits = spark.createDataFrame([(r.id, r.methods) for r in best], "id string, methods string")
    at = F.broadcast(hits.select(F.col("id").alias("node_id")))
    own = corpus.edges(spark, d).join(at.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    n = graph.around(own, _slim(spark, d), at)
    side = lambda w: graph.neighbours(n, w, at).withColumnsRenamed({"node_id": "id", "neighbour_id": f"{w}_id"})
    up = graph.parents(own, n).select(F.col("node_id").alias("id"), F.col("line").alias("parent_line"))
    texts = _nodes(spark, d).join(at, "node_id", "left_semi").withColumnRenamed("node_id", "id")
    rows = hits.join(texts, "id").join(up, "id", "left").join(side("next"), "id", "left").join(side("prev"), "id", "left")
    context = F.when(F.col("parent_line").isNotNull(), C.parent_context(F.lit("block"), F.col("file_path"), F.col("parent_line")))
    return rows.select("id", "methods", "file_path", "start_line", "content", F.array_join(C.distinct_labels(F.col("matches")), ", ").alias("labels"), context.alias("parent_context"), "next_id", "prev_id")


#: The forms of two words that share a stem.
_FORMS = [["license", "licensed", "licenses", "licensing"], ["right", "rights"]]
_FORM_COUNT = lambda c, forms: f"len(list_filter({c}, lambda t: t IN ({', '.join(repr(x) for x in forms)})))"
_FORM_WEIGHTS = [f"({_FORM_COUNT('ta', f)} * 1.0 + {_FORM_COUNT('tb', f)} * 0.4)" for f in _FORMS]
_FORM_RANK = "round(CAST(" + " + ".join(f"{w} / (1 + {w})" for w in _FORM_WEIGHTS) + " AS DOUBLE), 6)"


@query(sql(f"""SELECT id, score, file_path, start_line, content, label, parent_id, parent_context, next_id, prev_id FROM (SELECT f.node_id AS id, f.score, n.file_path, n.start_line, n.content,
  CASE WHEN n.has_matches THEN {LABEL.format('n.role')} ELSE 'Code Block' END AS label, p.parent_id,
  'Inside ' || CASE WHEN p2.has_matches THEN {LABEL.format('p2.role')} ELSE 'Code Block' END || ' defined in ' || n.file_path || ' (L' || p2.start_line || ')' AS parent_context, x.neighbour_id AS next_id, y.neighbour_id AS prev_id
  FROM (SELECT node_id, {_FORM_RANK} AS score FROM ({_TERMS}) WHERE ({_FORM_WEIGHTS[0]} > 0 OR {_FORM_WEIGHTS[1]} > 0) AND language IN ('en', 'de') ORDER BY score DESC, node_id LIMIT 15) f JOIN nodes n ON n.node_id = f.node_id
  LEFT JOIN parent p ON p.node_id = f.node_id LEFT JOIN nodes p2 ON p2.node_id = p.parent_id LEFT JOIN next x ON x.node_id = f.node_id LEFT JOIN prev y ON y.node_id = f.node_id)""", "parent", "next", "prev"))
def q_engine_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The engine's whole path over a store with these tables: postings, filters, contents of the hits, parents and neighbours."""
    hits = corpus.engine(spark, d).retrieve("license or rights", snapshot="s2", strategy="keyword", limit=15, filters={"language": ["en", "de"]})
    return hits.select("id", "score", "file_path", "start_line", "content", "label", "parent_id", "parent_context", "next_id", "prev_id")


@query(sql(f"SELECT id, score, methods FROM ({_FUSED}) ORDER BY score DESC, v NULLS LAST, k NULLS LAST, id LIMIT 10", "emb", "q"))
def q_engine_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The engine's hybrid search, with the stored vectors."""
    return corpus.engine(spark, d).retrieve("class or definition", snapshot="s2", vector=_first_vector(spark, d), limit=10).select("id", "score", "methods")


# graph


@query(sql("SELECT * FROM incoming", "incoming"))
def q_incoming(spark: SparkSession, d: str) -> DataFrame:
    return graph.incoming(corpus.edges(spark, d), _slim(spark, d))


@query(sql("SELECT * EXCLUDE n FROM outgoing", "outgoing"))
def q_outgoing(spark: SparkSession, d: str) -> DataFrame:
    return graph.outgoing(corpus.edges(spark, d), _slim(spark, d))


@query(sql("SELECT p.node_id, parent_id, file_path AS file, start_line AS line FROM parent p JOIN nodes n ON n.node_id = parent_id", "parent"))
def q_parents(spark: SparkSession, d: str) -> DataFrame:
    return graph.parents(corpus.edges(spark, d), _slim(spark, d))


@query(sql("SELECT target_id AS node_id, source_id AS child_id, file_path AS file, start_line AS line FROM edges JOIN nodes ON node_id = source_id WHERE relation_type = 'child_of'", "edges"))
def q_children(spark: SparkSession, d: str) -> DataFrame:
    return graph.children(corpus.edges(spark, d), _slim(spark, d))


@query(sql("""SELECT * EXCLUDE n FROM (SELECT source_id, target_id, file_path AS file, start_line AS line, relation_type AS relation, coalesce(symbol, 'unknown') AS symbol,
  row_number() OVER (PARTITION BY source_id ORDER BY file_path, start_line, target_id, coalesce(symbol, 'unknown')) AS n
  FROM edges JOIN nodes ON node_id = target_id WHERE relation_type IN ('calls', 'references')) WHERE n <= 15""", "edges"))
def q_context(spark: SparkSession, d: str) -> DataFrame:
    return graph.context(corpus.edges(spark, d), _slim(spark, d))


@query(sql("""SELECT node_id, via FROM (SELECT c.node_id, 'center' AS via FROM c UNION SELECT target_id, 'outgoing' FROM edges WHERE relation_type <> 'child_of' AND source_id IN (SELECT node_id FROM c)
  UNION SELECT source_id, 'incoming' FROM edges WHERE relation_type <> 'child_of' AND target_id IN (SELECT node_id FROM c)
  UNION SELECT target_id, 'parent' FROM edges WHERE relation_type = 'child_of' AND source_id IN (SELECT node_id FROM c)
  UNION SELECT source_id, 'child' FROM edges WHERE relation_type = 'child_of' AND target_id IN (SELECT node_id FROM c))""", "edges").replace("\nSELECT node_id, via", ", c AS (SELECT min(node_id) AS node_id FROM nodes WHERE seq = 1)\nSELECT node_id, via", 1))
def q_ego_graph(spark: SparkSession, d: str) -> DataFrame:
    n = _slim(spark, d)
    center = n.filter("seq = 1").agg(F.min("node_id")).first()[0]
    return graph.ego(corpus.edges(spark, d), n, F.col("node_id") == center)


@query(sql("""SELECT root_id, depth, path FROM t""", "outgoing").replace("\nSELECT root_id", """, step AS (SELECT DISTINCT source_id, target_id FROM outgoing WHERE n <= 10),
t AS (SELECT node_id AS root_id, CAST(0 AS INTEGER) AS depth, node_id AS path, node_id AS cur FROM nodes WHERE seq = 1
  UNION ALL SELECT root_id, CAST(depth + 1 AS INTEGER), path || '>' || target_id, target_id FROM t JOIN step ON source_id = cur WHERE depth < 2)
SELECT root_id""", 1))
def q_call_tree_d2(spark: SparkSession, d: str) -> DataFrame:
    n = _slim(spark, d)
    return graph.call_tree(corpus.edges(spark, d), n, n.filter("seq = 1"))


@query(sql("SELECT * EXCLUDE n FROM outgoing WHERE source_id IN (SELECT node_id FROM parent)", "outgoing", "parent"))
def q_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependencies(corpus.edges(spark, d), _slim(spark, d))


@query(sql("SELECT * FROM next", "next"))
def q_next_chunk(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_slim(spark, d), "next")


@query(sql("SELECT * FROM prev", "prev"))
def q_prev_chunk(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_slim(spark, d), "prev")


@query(sql(f"""SELECT n.node_id, x.neighbour_id AS next_id, y.neighbour_id AS prev_id, parent_id,
  CASE WHEN p2.has_matches THEN CASE p2.role WHEN '' THEN '' ELSE {LABEL.format('p2.role')} END WHEN parent_id IS NOT NULL THEN 'Code Block' END AS parent_label
  FROM nodes n LEFT JOIN next x USING (node_id) LEFT JOIN prev y USING (node_id) LEFT JOIN parent p USING (node_id) LEFT JOIN nodes p2 ON p2.node_id = parent_id""", "next", "prev", "parent"))
def q_nav_metadata(spark: SparkSession, d: str) -> DataFrame:
    n = _slim(spark, d)
    up = graph.parents(corpus.edges(spark, d), n).select("node_id", "parent_id")
    label = n.select(F.col("node_id").alias("parent_id"), C.primary_label(F.col("matches")).alias("parent_label"))
    side = lambda w: graph.neighbours(n, w).withColumnRenamed("neighbour_id", f"{w}_id")
    return n.select("node_id").join(side("next"), "node_id", "left").join(side("prev"), "node_id", "left").join(up, "node_id", "left").join(label, "parent_id", "left").select("node_id", "next_id", "prev_id", "parent_id", "parent_label")


@query(sql("""SELECT DISTINCT target_id AS center_id, source_id AS source, target_id AS target, relation FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY file, line, source_id, relation, symbol NULLS FIRST) AS m FROM incoming) WHERE m <= 20""", "incoming"))
def q_impact_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact_graph(corpus.edges(spark, d), _slim(spark, d))


@query(sql("""SELECT DISTINCT center_id, source, target, relation FROM (
  SELECT r.node_id AS center_id, a.source_id AS source, a.target_id AS target, a.relation FROM nodes r JOIN step a ON a.source_id = r.node_id WHERE r.seq = 1
  UNION ALL SELECT r.node_id, b.source_id, b.target_id, b.relation FROM nodes r JOIN step a ON a.source_id = r.node_id JOIN step b ON b.source_id = a.target_id WHERE r.seq = 1)""", "outgoing").replace("\nSELECT DISTINCT center_id", ", step AS (SELECT DISTINCT source_id, target_id, relation FROM outgoing WHERE n <= 10)\nSELECT DISTINCT center_id", 1))
def q_pipeline_flat(spark: SparkSession, d: str) -> DataFrame:
    n = _slim(spark, d)
    return graph.pipeline_graph(corpus.edges(spark, d), n, n.filter("seq = 1"))


@query(sql("""SELECT node_id AS center_id, node_id AS source, neighbour_id AS target, 'next' AS relation FROM next UNION SELECT node_id, neighbour_id, node_id, 'next' FROM prev
  UNION SELECT node_id, node_id, parent_id, 'child_of' FROM parent""", "next", "prev", "parent"))
def q_neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbour_graph(corpus.edges(spark, d), _slim(spark, d))


@query(sql("""SELECT node_id AS center_id, node_id, 'center' AS type FROM parent UNION SELECT node_id, parent_id, 'parent' FROM parent""", "parent"))
def q_parent_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph_nodes(graph.parent_graph(corpus.edges(spark, d), _slim(spark, d)), "parent")


def _with_libraries(spark: SparkSession, d: str) -> DataFrame:
    """The edges, and imports of modules outside the snapshot."""
    own = _slim(spark, d).filter("seq = 1").select(F.col("node_id").alias("source_id"), F.concat(F.lit("lib_"), (F.col("doc_id") % 17).cast("string")).alias("target_id"), F.lit("imports").alias("relation_type"), F.lit("lib").alias("symbol"))
    return corpus.edges(spark, d).unionByName(own)


@query(sql("SELECT DISTINCT 'lib_' || doc_id % 17 AS node_id FROM nodes WHERE seq = 1", "nodes"))
def q_external_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.external_nodes(_with_libraries(spark, d), _slim(spark, d))


@query(sql("SELECT node_id AS source_id, 'lib_' || doc_id % 17 AS target_id, 'lib_' || doc_id % 17 AS file, CAST(NULL AS INTEGER) AS line FROM nodes WHERE seq = 1", "nodes"))
def q_outgoing_external(spark: SparkSession, d: str) -> DataFrame:
    """Imports of libraries show in navigation, through their phantom nodes."""
    edges = _with_libraries(spark, d)
    found = graph.outgoing(edges, graph.with_external(edges, _slim(spark, d)), ("imports",), None)
    return found.filter("target_id like 'lib\\_%'").select("source_id", "target_id", "file", "line")


@query(sql("""SELECT source_id AS node_id, array_to_string(list_transform(list_sort(list(first))[:5], lambda x: x.symbol), ',') AS symbols
  FROM (SELECT source_id, symbol, min({'f': file, 'l': line, 't': target_id, 'symbol': symbol}) AS first FROM outgoing WHERE symbol IS NOT NULL AND symbol <> 'unknown' AND NOT contains(symbol, '<') GROUP BY 1, 2) GROUP BY 1""", "outgoing"))
def q_first_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The first five distinct symbols of what each node refers to, in the order of the references."""
    sane = graph.outgoing(corpus.edges(spark, d), _slim(spark, d)).filter("symbol is not null and symbol <> 'unknown' and symbol not like '%<%'")
    inorder = F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "target_id", "symbol"))), lambda x: x["symbol"])
    return sane.groupBy(F.col("source_id").alias("node_id")).agg(F.array_join(F.slice(F.array_distinct(inorder), 1, 5), ",").alias("symbols"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.documents(spark, d).select(F.col("doc_id").alias("ref"), "path", ((F.col("doc_id") * 37) % 1500).alias("start"), ((F.col("doc_id") * 37) % 1500 + 60).alias("end"))


@query(sql("""SELECT ref, node_id FROM (SELECT r.doc_id AS ref, node_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY "end" - start, start, node_id) AS n
  FROM d r JOIN nodes ON file_path = path AND start <= (r.doc_id * 37) % 1500 + 1 AND "end" >= (r.doc_id * 37) % 1500 + 59) WHERE n = 1""", "nodes"))
def q_find_chunk(spark: SparkSession, d: str) -> DataFrame:
    return graph.enclosing(_refs(spark, d), _slim(spark, d))


@query(sql("""SELECT source_id, target_id, 'calls' AS relation_type, 'sym' AS symbol FROM (
  SELECT s.node_id AS source_id, CASE WHEN s.ref % 5 = 0 THEN s.path ELSE t.node_id END AS target_id FROM at0 s LEFT JOIN at1 t ON t.ref = s.ref) WHERE target_id IS NOT NULL AND source_id <> target_id""", "nodes").replace("\nSELECT source_id", """, at0 AS (SELECT * FROM (SELECT r.doc_id AS ref, path, node_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY "end" - start, start, node_id) AS n FROM d r JOIN nodes ON file_path = path AND start <= 11 AND "end" >= 19) WHERE n = 1),
at1 AS (SELECT * FROM (SELECT r.doc_id AS ref, path, node_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY "end" - start, start, node_id) AS n FROM d r JOIN nodes ON file_path = path AND start <= (r.doc_id * 37) % 1500 + 1 AND "end" >= (r.doc_id * 37) % 1500 + 59) WHERE n = 1)
SELECT source_id""", 1))
def q_resolve_edges(spark: SparkSession, d: str) -> DataFrame:
    r = _refs(spark, d)
    rel = r.select("ref", F.col("path").alias("source_path"), F.lit(10).cast("long").alias("source_start"), F.lit(20).cast("long").alias("source_end"), F.col("path").alias("target_path"), F.col("start").alias("target_start"), F.col("end").alias("target_end"), F.lit("calls").alias("relation_type"), F.lit("sym").alias("symbol"), (F.col("ref") % 5 == 0).alias("external"))
    return graph.resolve_edges(rel, _slim(spark, d))


# reader


@query(sql("SELECT path, coalesce(string_agg(content, '' ORDER BY start), '') AS content FROM files LEFT JOIN (SELECT file_id, content, start FROM nodes) USING (file_id) GROUP BY path", "nodes"))
def q_read_file(spark: SparkSession, d: str) -> DataFrame:
    return reader.read_files(_nodes(spark, d), corpus.files(spark, d)).select("path", "content")


@query(sql("""SELECT path, coalesce(array_to_string(list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i < len(p) THEN p[i] || chr(10) ELSE p[i] END), lambda x, i: i > greatest(3 - first_line, 0) AND i <= 9 - first_line + 1), ''), '') AS content
  FROM files LEFT JOIN (SELECT file_id, string_split(string_agg(content, '' ORDER BY start), chr(10)) AS p, min(start_line) AS first_line FROM nodes WHERE end_line >= 3 AND start_line <= 9 GROUP BY 1) USING (file_id)""", "nodes"))
def q_read_range(spark: SparkSession, d: str) -> DataFrame:
    return reader.read_range(_nodes(spark, d), corpus.files(spark, d), 3, 9)


_TREE = """SELECT DISTINCT array_to_string(p[1:i - 1], '/') AS dir, p[i] AS name, CASE WHEN i = len(p) THEN 'file' ELSE 'dir' END AS type, array_to_string(p[1:i], '/') AS path
  FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM files)"""


@query(sql(f"SELECT name, type, path FROM ({_TREE}) WHERE dir = 'src1'", "files"))
def q_list_dir(spark: SparkSession, d: str) -> DataFrame:
    return reader.list_directory(corpus.files(spark, d), "src1")


@query(sql(f"SELECT path FROM ({_TREE}) WHERE type = 'dir' AND contains(lower(name), 'es') ORDER BY path LIMIT 25", "files"))
def q_find_dirs(spark: SparkSession, d: str) -> DataFrame:
    return reader.find_directories(corpus.files(spark, d), "ES", 25)


@query(sql(_TREE, "files"))
def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    return reader.entries(corpus.files(spark, d))


@query(sql(f"""SELECT path, name, CASE WHEN type = 'dir' THEN 'directory' ELSE 'file' END AS type, dir AS parent, CAST(row_number() OVER (PARTITION BY dir ORDER BY type <> 'dir', name) AS INTEGER) AS place FROM ({_TREE})""", "files"))
def q_file_tree(spark: SparkSession, d: str) -> DataFrame:
    return reader.file_tree(corpus.files(spark, d))


@query(sql("""SELECT path, coalesce(string_agg(content, '' ORDER BY start), '') AS content, count(node_id) AS n, coalesce(string_agg(start || '-' || "end" || ' L' || start_line || '-' || end_line || ' ' || node_id, ',' ORDER BY start), '') AS chunks
  FROM files LEFT JOIN nodes USING (file_id) GROUP BY path""".replace("SELECT path,", "SELECT files.path,").replace("GROUP BY path", "GROUP BY files.path"), "nodes"))
def q_file_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Each file with the places of its chunks."""
    place = F.transform("chunks", lambda c: F.format_string("%d-%d L%d-%d %s", c["start"], c["end"], c["start_line"], c["end_line"], c["node_id"]))
    rows = reader.overlay(_nodes(spark, d), corpus.files(spark, d))
    return rows.select("path", "content", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(place, ","), F.lit("")).alias("chunks"))


@query(sql("SELECT chunk_hash, any_value(content) AS content FROM nodes WHERE seq = 2 GROUP BY 1", "nodes"))
def q_contents_bulk(spark: SparkSession, d: str) -> DataFrame:
    """The contents of a list of hashes."""
    n = _nodes(spark, d)
    return n.select("chunk_hash", "content").dropDuplicates(["chunk_hash"]).join(n.filter("seq = 2").select("chunk_hash").distinct(), "chunk_hash", "left_semi")


@query(sql("SELECT path, file_id, file_hash FROM files WHERE doc_id % 2 = 0 ORDER BY path", "files"))
def q_files_bulk(spark: SparkSession, d: str) -> DataFrame:
    """The files of a list of paths, some of which don't exist."""
    asked = corpus.files(spark, d, "s1").select("path").unionByName(spark.createDataFrame([("none.py",)], "path string"))
    return corpus.files(spark, d).join(asked, "path", "left_semi").select("path", "file_id", "file_hash").orderBy("path")


@query(sql("SELECT node_id, n.file_path, n.start_line, source AS repository, content FROM nodes n JOIN files USING (file_id) WHERE source IN (SELECT max(source) FROM files)", "nodes"))
def q_nodes_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with their file's repository, of one repository."""
    f = corpus.files(spark, d)
    one = f.join(F.broadcast(f.agg(F.max("source").alias("source"))), "source", "left_semi")  # one row
    return _nodes(spark, d).join(one.select("file_id", F.col("source").alias("repository")), "file_id").select("node_id", "file_path", "start_line", "repository", "content")


# embedding pipeline

_PROMPT = f"""'File: ' || file_path || chr(10) || 'Language: ' || language || chr(10) || 'Category: ' || category || chr(10) || CASE WHEN has_matches THEN 'Role: ' || {LABEL.format('role')} || chr(10) ELSE '' END
  || coalesce('Defines: ' || symbols || chr(10), '') || '[CODE]' || chr(10) || content"""
_SYMBOLS = "SELECT target_id AS node_id, array_to_string(list_sort(list(DISTINCT symbol)), ', ') AS symbols FROM edges WHERE relation_type = 'calls' AND symbol IS NOT NULL GROUP BY 1"


@query(sql(f"SELECT node_id, sha256({_PROMPT}) AS vector_hash FROM nodes LEFT JOIN ({_SYMBOLS}) USING (node_id)", "edges"))
def q_prompt_hash(spark: SparkSession, d: str) -> DataFrame:
    return embedding.stage(_nodes(spark, d), corpus.edges(spark, d), MODEL).select("node_id", "vector_hash")


def _history(spark: SparkSession, d: str) -> DataFrame:
    e = corpus.embeddings(spark, d)
    return e.select("id", F.col("node_id").alias("chunk_id"), F.col("label").cast("string").alias("vector_hash"), F.when(F.col("label") % 2 == 0, MODEL).otherwise("model-2").alias("model_name"), "embedding")


@query(sql("SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM emb WHERE label % 2 = 0)", "emb"))
def q_nodes_to_embed(spark: SparkSession, d: str) -> DataFrame:
    return embedding.nodes_to_embed(_slim(spark, d), _history(spark, d), MODEL).select("node_id")


@query(sql(_SYMBOLS, "edges"))
def q_incoming_symbols(spark: SparkSession, d: str) -> DataFrame:
    return embedding.incoming_symbols(corpus.edges(spark, d)).select("node_id", F.array_join("symbols", ", ").alias("symbols"))


def _staged(spark: SparkSession, d: str) -> DataFrame:
    return _slim(spark, d).select("node_id", (F.col("doc_id") % 20).cast("string").alias("vector_hash"), F.lit(MODEL).alias("model_name"))


_FILLED = "SELECT node_id, doc_id % 20 AS h, first_id FROM nodes LEFT JOIN (SELECT label, min(id) AS first_id FROM emb WHERE label % 2 = 0 GROUP BY 1) ON label = doc_id % 20"


@query(sql(f"SELECT f.node_id, {_CHECKSUM.format('e.embedding')} AS components FROM ({_FILLED}) f LEFT JOIN emb e ON e.id = first_id", "emb"))
def q_backfill(spark: SparkSession, d: str) -> DataFrame:
    filled = embedding.backfill(_staged(spark, d), _history(spark, d))
    return filled.select("node_id", _checksum("embedding").alias("components"))


@query(sql(f"SELECT node_id FROM ({_FILLED}) WHERE first_id IS NOT NULL", "emb"))
def q_flush_hits(spark: SparkSession, d: str) -> DataFrame:
    return embedding.split_hits(embedding.backfill(_staged(spark, d), _history(spark, d)))[0].select("node_id")


@query(sql(f"SELECT node_id FROM ({_FILLED}) WHERE first_id IS NULL", "emb"))
def q_delta(spark: SparkSession, d: str) -> DataFrame:
    return embedding.split_hits(embedding.backfill(_staged(spark, d), _history(spark, d)))[1].select("node_id")


@query(sql(f"""SELECT count(*) AS staged, count(first_id) AS recovered, count(*) - count(first_id) AS to_embed, count(DISTINCT h) AS prompts, count(DISTINCT file_id) AS files FROM (SELECT file_id, doc_id % 20 AS h, first_id FROM nodes LEFT JOIN (SELECT label, min(id) AS first_id FROM emb WHERE label % 2 = 0 GROUP BY 1) ON label = doc_id % 20)""", "emb"))
def q_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters of an embedding run in one pass."""
    staged = _slim(spark, d).select("node_id", "file_id", (F.col("doc_id") % 20).cast("string").alias("vector_hash"), F.lit(MODEL).alias("model_name"))
    return embedding.backfill(staged, _history(spark, d)).agg(
        F.count(F.lit(1)).alias("staged"), F.count("embedding").alias("recovered"), F.count_if(F.col("embedding").isNull()).alias("to_embed"),
        F.count_distinct("vector_hash").alias("prompts"), F.count_distinct("file_id").alias("files"),
    )


@query()
def q_seeded_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in vectors of all prompts, which depend on the text alone."""
    n = _nodes(spark, d).select("node_id", vectors.seeded_vector(F.col("content"), 16).alias("embedding"))
    return n.select("node_id", _checksum("embedding").alias("components"))


# lifecycle and statistics


@query(sql("""SELECT 'files' AS "table", count(*) AS n FROM files UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'embeddings', count(*) FROM emb UNION ALL SELECT 'contents', count(DISTINCT chunk_hash) FROM nodes""", "files", "edges", "emb"))
def q_stats(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.counts({"files": corpus.files(spark, d), "nodes": _slim(spark, d), "edges": corpus.edges(spark, d), "embeddings": corpus.embeddings(spark, d), "contents": _slim(spark, d).select("chunk_hash").distinct()})


@query(sql("SELECT repository, max(snapshot) AS snapshot FROM log WHERE status = 'completed' GROUP BY 1", "log"))
def q_snapshot_active(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.active(corpus.log(spark, d), "repository", "snapshot")


@query(sql("SELECT repository, \"commit\", max(snapshot) AS snapshot FROM log WHERE status = 'completed' GROUP BY 1, 2", "log"))
def q_snapshot_reuse(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.reusable(corpus.log(spark, d), "repository", "commit", "snapshot")


@query(sql("SELECT repository FROM log GROUP BY 1 HAVING arg_max(status, seq) = 'indexing'", "log"))
def q_lock_state(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.locked(corpus.log(spark, d), "repository")


@query(sql("SELECT repository, arg_max(status, seq) AS status, max(seq) AS seq FROM log GROUP BY 1", "log"))
def q_snapshot_state(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.state(corpus.log(spark, d), "repository")


@query(sql("""SELECT path, CASE WHEN o.path IS NULL THEN 'added' ELSE 'modified' END AS change FROM files n LEFT JOIN (SELECT path AS p0, path, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE file_hash END AS h FROM files1) o USING (path)
  WHERE o.p0 IS NULL OR h <> file_hash""", "files", "files1").replace("WHEN o.path IS NULL", "WHEN o.p0 IS NULL"))
def q_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    old = corpus.files(spark, d, "s1").withColumn("file_hash", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("file_hash")))
    return reader.changed(old, corpus.files(spark, d))


@query(sql("SELECT snapshot_id, category, count(*) AS n FROM (SELECT snapshot_id, category FROM files UNION ALL SELECT snapshot_id, category FROM files1) GROUP BY 1, 2", "files", "files1"))
def q_isolation_counts(spark: SparkSession, d: str) -> DataFrame:
    both = corpus.files(spark, d).unionByName(corpus.files(spark, d, "s1"))
    return both.groupBy("snapshot_id", "category").agg(F.count(F.lit(1)).alias("n"))


_DAMAGED = "CASE doc_id % 4 WHEN 0 THEN chr(0) || text WHEN 1 THEN repeat(text || ' ', 2) ELSE text END"
_BIG = "CASE WHEN doc_id % 10 = 3 THEN 2000000 ELSE strlen(t) END"


@query(sql(f"""SELECT status, coalesce(reason, '') AS reason, count(*) AS n FROM (SELECT CASE WHEN reason IS NULL THEN 'success' ELSE 'skipped' END AS status, reason FROM (SELECT
  CASE WHEN size > 1048576 THEN 'File too large (' || printf('%.2f', size / 1048576.0) || ' MB)' WHEN contains(substring(t, 1, 1024), chr(0)) THEN 'Binary file detected'
    WHEN len(list_filter(string_split(substring(t, 1, 2048), chr(10))[1:5], lambda x: strlen(x) > 1000)) > 0 THEN 'Minified'
    WHEN regexp_matches(lower(substring(t, 1, 500)), 'generated by|auto-generated|do not edit') THEN 'Generated' END AS reason
  FROM (SELECT t, {_BIG} AS size FROM (SELECT doc_id, {_DAMAGED} AS t FROM d)))) GROUP BY 1, 2""", "d"))
def q_parsing_status(spark: SparkSession, d: str) -> DataFrame:
    """Files by status and reason, with binary and too large ones among them."""
    n = F.col("doc_id")
    t = corpus.documents(spark, d).withColumn("t", F.when(n % 4 == 0, F.concat(F.lit("\0"), "text")).when(n % 4 == 1, F.repeat(F.concat("text", F.lit(" ")), 2)).otherwise(F.col("text")))
    reason = C.skip_reason(F.col("path"), F.when(n % 10 == 3, 2_000_000).otherwise(F.octet_length("t")), F.col("t"))
    rows = t.select(reason.alias("reason")).withColumn("status", F.when(F.col("reason").isNull(), "success").otherwise("skipped"))
    return rows.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) END AS category, CASE WHEN contains(name, '.') THEN substring(name, instr(name, '.') + 1) END AS value
  FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'role.' || event_type ELSE 'type.' || event_type || '.x' END AS name FROM events)""")
def q_capture_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 3
    name = F.when(n == 0, "name").when(n == 1, F.concat(F.lit("role."), "event_type")).otherwise(F.concat(F.lit("type."), "event_type", F.lit(".x")))
    return corpus.table(spark, d, "events").select("event_id", C.capture_parts(name).alias("p")).select("event_id", "p.category", "p.value")


@query(sql("""SELECT node_id, '{"path":"' || file_path || '","line":' || start_line || ',"tags":' || CASE WHEN tags = '' THEN '[]' ELSE '["' || replace(tags, ' ', '","') || '"]' END || '}' AS json FROM nodes""", "nodes"))
def q_json_build(spark: SparkSession, d: str) -> DataFrame:
    tags = F.filter(F.split("tags", " "), lambda x: x != "")
    return _slim(spark, d).select("node_id", F.to_json(F.struct(F.col("file_path").alias("path"), F.col("start_line").alias("line"), tags.alias("tags"))).alias("json"))


@query(sql("SELECT path, NOT (ends_with(p, '.d.ts') OR ends_with(p, '.min.js')) AS processed FROM (SELECT path, CASE doc_id % 3 WHEN 0 THEN path || '.d.ts' WHEN 1 THEN path || '.min.js' ELSE path || '.ts' END AS p FROM files)", "files"))
def q_excluded_extensions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 3
    p = F.concat("path", F.when(n == 0, ".d.ts").when(n == 1, ".min.js").otherwise(".ts"))
    return corpus.files(spark, d).select("path", C.should_process(p, C.EXCLUDED_EXTENSIONS).alias("processed"))


@query(sql(f"""SELECT node_id, CASE WHEN role <> 'entry_point' THEN 'Inside ' || role || ' defined in ' || file_path || ' (L' || start_line || ')' END AS context FROM (SELECT *, CASE role WHEN 'entry_point' THEN 'module' END AS m FROM nodes)""", "nodes"))
def q_parent_context(spark: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in corpus.ROLES]), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = F.when(role == "entry_point", "module").otherwise(role)
    return _slim(spark, d).select("node_id", C.parent_context(kind, F.col("file_path"), F.col("start_line")).alias("context"))


@query(sql("""SELECT repository, "commit", max(snapshot) AS snapshot FROM (SELECT *, CASE WHEN snapshot % 4 = 0 THEN 'pruned' ELSE status END AS last FROM log) WHERE last = 'completed' GROUP BY 1, 2""", "log"))
def q_snapshot_not_pruned(spark: SparkSession, d: str) -> DataFrame:
    """A pruned snapshot isn't used again, although it was completed."""
    log = corpus.log(spark, d)
    gone = log.filter("snapshot % 4 = 0").withColumn("status", F.lit("pruned")).withColumn("seq", F.col("seq") + 1_000_000_000)
    return lifecycle.reusable(lifecycle.last_of(log.unionByName(gone), "snapshot"), "repository", "commit", "snapshot")


# chunker


@query("""SELECT item_id, lang, seq, byte_start, byte_end, start_line, end_line, kind FROM (
  SELECT item_id, 'py' AS lang, 0 AS seq, 0 AS byte_start, length(a) - 1 AS byte_end, 1 AS start_line, 61 AS end_line, 'function' AS kind FROM t
  UNION ALL SELECT item_id, 'py', 1, length(a) - 1, length(a) + length(b) - 1, 61, 92, 'class' FROM t
  UNION ALL SELECT item_id, 'js', 0, 0, length(e) - 1, 1, 62, 'function' FROM t
  UNION ALL SELECT item_id, 'js', 1, length(e) - 1, length(e) + length(f) - 1, 62, 94, 'class' FROM t)
""".replace("SELECT item_id, lang", """WITH t AS (SELECT item_id, 'def f' || item_id || '():' || chr(10) || repeat('    x = 1' || chr(10), 60) AS a, 'class C' || item_id || ':' || chr(10) || repeat('    y = 2' || chr(10), 30) AS b,
  'function f' || item_id || '() {' || chr(10) || repeat('    x = 1;' || chr(10), 60) || '}' || chr(10) AS e, 'class C' || item_id || ' {' || chr(10) || repeat('    y = 2;' || chr(10), 30) || '}' || chr(10) AS f FROM benchmark)
SELECT item_id, lang""", 1))
def q_chunk_source(spark: SparkSession, d: str) -> DataFrame:
    """A function and a class in a Python and in a JavaScript file for each item: a chunk each, what lies between goes with what follows."""
    i = F.col("item_id").cast("string")
    py = F.concat(F.lit("def f"), i, F.lit("():\n"), F.repeat(F.lit("    x = 1\n"), 60), F.lit("class C"), i, F.lit(":\n"), F.repeat(F.lit("    y = 2\n"), 30))
    js = F.concat(F.lit("function f"), i, F.lit("() {\n"), F.repeat(F.lit("    x = 1;\n"), 60), F.lit("}\nclass C"), i, F.lit(" {\n"), F.repeat(F.lit("    y = 2;\n"), 30), F.lit("}\n"))
    made = _source(spark, d, {"py": py, "js": js})
    return made.select("item_id", "lang", "seq", "byte_start", "byte_end", "start_line", "end_line", F.element_at("matches", 1)["value"].alias("kind"))


def _source(spark: SparkSession, d: str, files: dict[str, Column]) -> DataFrame:
    """The chunks of files made from each benchmark item."""
    t = corpus.table(spark, d, "benchmark")
    parts = [t.select(F.concat(F.col("item_id").cast("string"), F.lit("." + lang)).alias("path"), F.encode(text, "UTF-8").alias("content")) for lang, text in files.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    parsed = parse_files(rows.select("path", F.octet_length("content").cast("long").alias("size"), "content", F.lit(None).cast("string").alias("error")))
    return parsed.filter("seq is not null").withColumn("item_id", F.substring_index("path", ".", 1).cast("long")).withColumn("lang", F.substring_index("path", ".", -1))


@query("SELECT item_id, CAST(0 AS INTEGER) AS seq, CAST(0 AS INTEGER) AS byte_start FROM benchmark WHERE false")
def q_chunk_none(spark: SparkSession, d: str) -> DataFrame:
    """Files that make no chunk: blank ones, and those of unknown languages."""
    made = _source(spark, d, {"py": F.lit("  \n\n"), "txt": F.lit("text")})
    return made.select("item_id", "seq", F.col("byte_start").cast("int").alias("byte_start"))


@query("""SELECT item_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq = 0 THEN 0 ELSE 800 * seq - 94 END AS byte_start, least(800 * seq + 706, n) AS byte_end, CASE WHEN seq > 0 THEN 0 END AS parent
  FROM (SELECT item_id, n, unnest(range(0, CAST(1 + ceil((n - 706) / 800.0) AS BIGINT))) AS seq FROM (SELECT item_id, 1806 + 100 * (item_id % 7) AS n FROM benchmark))""")
def q_chunk_unparsed(spark: SparkSession, d: str) -> DataFrame:
    """A file that doesn't parse is split by bytes behind newlines; the later pieces are children of the first."""
    text = F.concat(F.lit("def (\n"), F.repeat(F.lit("x" * 99 + "\n"), (F.col("item_id") % 7 + 18).cast("int")))
    return _source(spark, d, {"py": text}).select("item_id", "seq", "byte_start", "byte_end", "parent")


@query("""SELECT item_id, u.role AS role, u.value AS value FROM (SELECT item_id, unnest([{'role': 'role', 'value': 'test_suite'}, {'role': 'type', 'value': 'class'}, {'role': 'type', 'value': 'function'}, {'role': 'role', 'value': 'test_case'},
  {'role': 'type', 'value': 'function'}, {'role': 'role', 'value': 'api_endpoint'}, {'role': 'role', 'value': 'entry_point'}]) AS u FROM benchmark)""")
def q_chunk_roles(spark: SparkSession, d: str) -> DataFrame:
    """The captures of a small Python file: a test class with a test in one chunk, an endpoint below ``if`` and the entry point in the next."""
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("class TestC"), i, F.lit(":\n    def test_a(self):\n        pass\nif True:\n    @app.get('/"), i, F.lit("')\n    def d():\n        pass\nif __name__ == '__main__':\n    d()\n"))
    made = _source(spark, d, {"py": text}).select("item_id", F.explode("matches").alias("m"))
    return made.select("item_id", F.col("m.category").alias("role"), "m.value")


# labels and rendering


@query(sql(f"SELECT node_id, CASE WHEN has_matches THEN array_to_string(list_sort(list_distinct([{LABEL.format('role')}, {LABEL.format('kind')}])), ', ') ELSE 'Code Block' END AS labels FROM nodes", "nodes"))
def q_distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    return _slim(spark, d).select("node_id", F.array_join(C.distinct_labels(F.col("matches")), ", ").alias("labels"))


@query(sql(f"SELECT node_id, CASE WHEN has_matches THEN {LABEL.format('role')} ELSE 'Code Block' END AS label FROM nodes", "nodes"))
def q_primary_label(spark: SparkSession, d: str) -> DataFrame:
    return _slim(spark, d).select("node_id", C.primary_label(F.col("matches")).alias("label"))


@query(sql("SELECT node_id, '### ' || file_path || ' (L' || start_line || '-L' || end_line || ')' AS header, 'Inside block defined in ' || file_path || ' (L' || start_line || ')' AS parent_context FROM nodes", "nodes"))
def q_render_header(spark: SparkSession, d: str) -> DataFrame:
    header = F.format_string("### %s (L%d-L%d)", "file_path", "start_line", "end_line")
    return _slim(spark, d).select("node_id", header.alias("header"), C.parent_context(F.lit("block"), F.col("file_path"), F.col("start_line")).alias("parent_context"))


@query(sql("SELECT DISTINCT symbol, first FROM (SELECT symbol, min(target_id) OVER (PARTITION BY symbol) AS first FROM edges WHERE symbol IS NOT NULL AND symbol <> 'unknown' AND NOT contains(symbol, '<') AND source_id <> target_id)", "edges"))
def q_symbols(spark: SparkSession, d: str) -> DataFrame:
    sane = F.col("symbol").isNotNull() & (F.col("symbol") != "unknown") & ~F.contains("symbol", F.lit("<")) & (F.col("source_id") != F.col("target_id"))
    return corpus.edges(spark, d).filter(sane).groupBy("symbol").agg(F.min("target_id").alias("first"))


@query("SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, lag(turn) OVER w AS parent_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def q_conversation_parent(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("parent_turn"))
