"""The catalog's queries over whole query sets, against their SQL."""

import os

import pytest
from conftest import DATA

from tessera import catalog
from tessera.operators import encoder, retrieval

NAMES = ["bm25_topk", "rrf_fuse", "fusion_census", "query_bm25_minmax", "hybrid_score", "score_cache_stats", "score_cache_misses", "knapsack", "drop_histogram", "assemble_context", "baseline_context", "fact_retention", "sse_frames", "bm25_zero_pool"]


def answer(d, sql):
    import duckdb

    c = duckdb.connect()
    for name in ("benchmark", "documents", "embeddings"):
        c.execute(f"create view {name} as from '{d}/{name}.parquet'")
    return sorted(map(repr, c.execute(sql).fetchall()))


@pytest.mark.parametrize("name", NAMES)
def test_all_items_are_queries(spark, name):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    got = sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, DATA).collect())
    assert got == answer(DATA, catalog.ORACLE_SQL[name]) and got


@pytest.mark.parametrize("name", ["mmr_greedy", "compression_summary", "compressed_context", "budget_sweep"])
def test_every_item_has_rows(spark, name):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    items = {r[0] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id").collect()}
    out = catalog.QUERIES[name](spark, DATA)
    assert {r[0] for r in out.select("query_id").distinct().collect()} == items


def test_dense_topk_takes_every_fiftieth(spark, monkeypatch):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    monkeypatch.setattr(retrieval, "PASS", 4)
    got = sorted(repr(tuple(r)) for r in catalog.QUERIES["dense_topk"](spark, DATA).collect())
    assert got == answer(DATA, catalog.ORACLE_SQL["dense_topk"]) and len(got) == 500


def test_dense_topk_ties_and_blocks(spark):
    import pandas as pd

    v = [[1.0, 0.0] if i % 3 else [0.0, 1.0] for i in range(300)]
    x = spark.createDataFrame(pd.DataFrame({"vec_id": range(300), "embedding": v})).repartition(7)
    q = x.selectExpr("vec_id query_id", "embedding qvec")
    got = {}
    for r in retrieval.dense_topk(x, q, 5).collect():
        got.setdefault(r["query_id"], []).append((r["dense_rank"], r["vec_id"], r["similarity"]))
    alike = lambda i: [j for j in range(300) if v[j] == v[i]][:5]
    assert {i: sorted(r) for i, r in got.items()} == {i: [(k + 1, j, 1.0) for k, j in enumerate(alike(i))] for i in range(300)}


def test_encoder_queries_against_numpy(spark, monkeypatch):
    import numpy as np

    if not os.path.exists(DATA):
        pytest.skip("no test data")
    kept = []
    fit = encoder.fit
    monkeypatch.setattr(encoder, "fit", lambda *a, **k: kept.append(fit(*a, **k)) or kept[-1])
    got = {(r["query_id"], r["doc_id"]): r["similarity"] for r in catalog.QUERIES["encoder_topk"](spark, DATA).collect()}
    vectors = lambda df, k, t: {r[k]: np.array(r["embedding"], float) for r in kept[0].encode(df, [k], t).where("embedding is not null").collect()}
    docs, items = vectors(catalog.documents(spark, DATA), "doc_id", "text"), vectors(catalog.queries_of(spark, DATA), "query_id", "query")
    for q, v in items.items():
        best = sorted((-round(float(v @ x), 6), d) for d, x in docs.items())[:20]
        assert min(-s for s, _ in best) - 1e-5 <= min(s for (i, _), s in got.items() if i == q) and len([1 for i, _ in got if i == q]) == 20
    fused = catalog.QUERIES["encoder_fuse"](spark, DATA).collect()
    assert {r["query_id"] for r in fused} == set(items) and all(r["dense_rank"] or r["bm25_rank"] for r in fused)
