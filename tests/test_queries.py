"""Every reference query against its DuckDB twin on the smallest tables."""

import math
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest
from codeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), names)


def test_seeded_vectors_depend_on_the_text(spark):
    n = catalogue.QUERIES["q_seeded_vectors"](spark, SF)
    again = {r.node_id: r.components for r in n.collect()}
    assert len(again) == n.count() and again == {r.node_id: r.components for r in n.collect()} and len(set(again.values())) > 500


def test_knn_passes_over_documents_without_first_chunk(spark, tmp_path):
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    best = [r[0] for r in c.execute(catalogue.ORACLES["q_knn"]).fetchall()]
    c.execute(f"CREATE TABLE d AS SELECT * REPLACE (CASE WHEN doc_id IN ({', '.join(map(str, best[:3]))}) THEN NULL WHEN doc_id IN ({', '.join(map(str, best[3:9]))}) THEN repeat(' ', 800) || text ELSE text END AS text) FROM documents")
    c.execute(f"COPY d TO '{tmp_path}/documents.parquet'; COPY embeddings TO '{tmp_path}/embeddings.parquet'; DROP VIEW documents; ALTER TABLE d RENAME TO documents")
    got = catalogue.QUERIES["q_knn"](spark, str(tmp_path))
    want = c.execute(catalogue.ORACLES["q_knn"])
    names = [x[0] for x in want.description]
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), names) and got.count() == 20


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())
