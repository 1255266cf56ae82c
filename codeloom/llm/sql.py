"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES

ORACLES: dict[str, str] = {}

ORACLES["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

#: The level of a source's limit, 3 * size / weight, orders sources; those at or below the common level stop at their limit.
ORACLES["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM d GROUP BY source),
o AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
         CAST(coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS capped, CAST(coalesce(sum(w) OVER before, 0) AS BIGINT) AS capped_w
  FROM s WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (
  SELECT arg_min(CAST(total - capped AS DOUBLE) / (all_w - capped_w), capped_w) AS level, min(CAST(3 * source_size AS DOUBLE) / w) AS at
  FROM o WHERE 3 * source_size * (all_w - capped_w) > (total - capped) * w),
t AS (
  SELECT source, source_size,
         CASE WHEN stop.at IS NULL OR CAST(3 * source_size AS DOUBLE) / w < stop.at THEN CAST(3 * source_size AS DOUBLE) ELSE w * stop.level END AS target
  FROM o, stop),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (SELECT *, CASE WHEN upto <= rest THEN 1 ELSE 0 END AS pick FROM r),
g AS (SELECT *, rest - sum(size * pick) OVER (PARTITION BY source) AS gap FROM k),
f AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN pick = 0 AND size > 0 AND gap > 0.5 AND size < 2 * gap THEN 0 ELSE 1 END, abs(gap - size), key, doc_id, size) AS n
  FROM g)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + pick + CASE WHEN n = 1 AND pick = 0 AND size > 0 AND gap > 0.5 AND size < 2 * gap THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM f
"""

ORACLES["op3_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, CAST(sum(hash(g)) AS VARCHAR) || ' ' || CAST(sum(hash(g || 'x')) AS VARCHAR) AS whole FROM s GROUP BY 1),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, whole) AS class_id FROM n),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 70 * (a.n + b.n - k)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, t.y FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) t ON t.x = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM documents d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) m ON m.a = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
LEFT JOIN (
  SELECT x.class_id, count(DISTINCT y.class_id) AS n_links FROM (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) t JOIN c x ON x.doc_id = t.x JOIN c y ON y.doc_id = t.y
  WHERE x.class_id <> y.class_id GROUP BY 1) l USING (class_id)
"""

ORACLES["op7_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

#: Bytes are pairs of hexadecimal digits; windows are taken from short parts of a text, as a long string is slow to reach into.
ORACLES["op8_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, k, substring(h, 512 * k + 1, 710) AS part FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 100) // 256 + 1)) AS k FROM d WHERE length(h) >= 200)),
w AS (SELECT doc_id, 256 * k + i AS s, md5_number(substring(part, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, k, part, unnest(range(0, least(256, length(part) // 2 - 99))) AS i FROM q)),
f AS (SELECT g, min({'doc': doc_id, 's': s}) AS first FROM w GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER p + 100 THEN 1 ELSE 0 END AS begins FROM w JOIN f USING (g) WHERE {'doc': doc_id, 's': s} > first WINDOW p AS (PARTITION BY doc_id ORDER BY s)),
n AS (SELECT doc_id, s, sum(begins) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM r),
x AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM n GROUP BY doc_id, run),
y AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
z AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept FROM y JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)
"""

_LIST = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
ORACLES["op2_license_scan"] = f"""
WITH t AS (SELECT name, {_WORDS} AS w FROM (VALUES {_LIST}) AS v(name, text)),
ts AS (SELECT DISTINCT name, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT name, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM t)),
tn AS (SELECT name, count(*) AS n, max(len(w) - 2) AS wide FROM ts JOIN t USING (name) GROUP BY 1),
ds AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0)),
h AS (SELECT doc_id, name, i, g, wide FROM ds JOIN ts USING (g) JOIN tn USING (name)),
k AS (
  SELECT a.doc_id, a.name, a.i, count(DISTINCT b.g) AS k FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.name = b.name AND b.i >= a.i AND b.i < a.i + a.wide
  GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY k DESC, i) AS best FROM k),
f AS (SELECT doc_id, name, name || '@' || CAST(round(1000 * CAST(k AS DOUBLE) / n) AS INTEGER) || '@' || (i - 1) AS place FROM b JOIN tn USING (name) WHERE best = 1 AND k >= 0.8 * n)
SELECT doc_id, count(name) AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses, coalesce(string_agg(place, ',' ORDER BY name), '') AS places FROM documents LEFT JOIN f USING (doc_id) GROUP BY 1
"""
