"""Every core query with SQL equals DuckDB on the smallest tables; scans are pruned."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom.plans import registry


def _norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return x


#: Searches ask the rows whose number is divisible by 100: the smallest tables have none.
LARGER = {"bm25_topk", "dense_topk", "fuse_weighted", "fuse_rrf", "fuse_rrf_alpha", "fusion_trace", "variant_merge", "best_rank_merge", "rerank_overlap", "hybrid_retrieve", "variant_routing", "bernoulli_sample"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for schema, folder in (("small", sf), ("larger", sf.replace("sf0.001", "sf0.01"))):
        c.execute(f"create schema {schema}")
        for f in glob.glob(f"{folder}/*.parquet"):
            c.execute(f"create view {schema}.{os.path.basename(f)[:-8]} as from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, db, name):
    df = registry.queries()[name](spark, sf.replace("sf0.001", "sf0.01") if name in LARGER else sf)
    got = df.collect()
    assert got, "a comparison of nothing with nothing"
    db.execute(f"use {'larger' if name in LARGER else 'small'}")
    res = db.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    mine = sorted(repr([_norm(r[c]) for c in order]) for r in got)
    at = [cols.index(c) for c in order]
    theirs = sorted(repr([_norm(r[i]) for i in at]) for r in res.fetchall())
    assert mine == theirs


def test_scan_is_pruned(spark, sf):
    plan = registry.queries()["chunk_bounds"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "embedding_text" not in plan


def test_entry_without_llm(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "llm_queries", None)
    assert e.entry.__doc__ and "bm25_topk" in e.queries() and not any(q.startswith("p1_") for q in e.queries())


def test_index_documents_keep_whole_texts_and_empty_ones(spark, sf):
    got = registry.queries()["index_documents"](spark, sf)
    t = spark.read.parquet(f"{sf}/transcript_v3.parquet").select("chunk_id", "chunk_text").distinct()
    assert len(got.columns) == 15 and got.count() == t.count()
    assert got.where("length(page_content) > 200").count() == t.where("length(chunk_text) > 200").count() > 0
