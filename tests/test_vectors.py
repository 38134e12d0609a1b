"""The inverted-file index against brute force: recall of a few probes, and exactness by bounds."""

import os

import numpy as np
import pytest
from conftest import DATA, rows

from tessera.operators import vectors

SF = DATA.replace("sf0.001", "sf0.1")


def clustered(seed=0, n=900, dims=12, centres=25, noise=0.35):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, dims))[rng.integers(centres, size=n)] + noise * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, list string, part int")


def brute(x, at, most):
    sim = np.round(x[at] @ x.T, 9)
    return sorted((int(q), int(j), float(s[j]), r + 1) for q, s in zip(at, sim) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s))[:most]))


def asked(v, every):
    return v.where(f"vec_id % {every} = 0").selectExpr("vec_id query_id", "embedding qvec")


@pytest.mark.parametrize("probes", [1, 4])
def test_exact_equals_brute_force(spark, tmp_path, monkeypatch, probes):
    monkeypatch.setattr(vectors, "PART", 40)
    monkeypatch.setattr(vectors, "ASKED", 7)
    x = clustered()
    x[100:400] = x[100]  # a third of all rows are one vector
    v = frame(spark, x).repartition(5)
    index = vectors.build(v, str(tmp_path / "i"), 20)
    assert index.vectors().count() == len(x) and index.centroids().agg({"parts": "max"}).first()[0] > 5
    got = sorted((r["query_id"], r["vec_id"], r["similarity"], r["dense_rank"]) for r in index.topk(asked(v, 30), 6, probes, exact=True).collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in brute(x, np.arange(0, len(x), 30), 6)]


def test_bounds_skip_lists(spark, tmp_path):
    x = clustered(noise=0.05)
    v = frame(spark, x)
    index = vectors.build(v, str(tmp_path / "i"), 25)
    q = asked(v, 30)
    found = index._look(q, index.pairs(q, 2), 5)
    rest = index.pairs(index.sure(q, found, 5), 2, beyond=True)
    assert rest.count() < 0.5 * 23 * q.count()  # most lists cannot hold anything better


def test_recall_of_a_few_probes(spark, tmp_path):
    if not os.path.exists(SF):
        pytest.skip("no test data")
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = np.array([r["embedding"] for r in v.orderBy("vec_id").select("embedding").collect()], float)
    ids = [r[0] for r in v.orderBy("vec_id").select("vec_id").collect()]
    index = vectors.build(v, str(tmp_path / "i"))
    probes = index.tune(asked(v.where("vec_id % 50 = 1"), 1), 50)  # tuned on other queries than those measured
    got = index.topk(asked(v, 50), 50, probes).collect()
    want = {(ids[q], ids[j]) for q, j, _, _ in brute(x, np.flatnonzero(np.array(ids) % 50 == 0), 50)}
    recall = len(want & {(r["query_id"], r["vec_id"]) for r in got}) / len(want)
    print(f"recall at 50: {recall:.3f} with {probes} of {index.centroids().count()} lists")
    assert recall >= 0.9 and probes < index.centroids().count()


def test_nulls_and_nothing(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], schema)
    q = v.selectExpr("vec_id query_id", "embedding qvec")
    assert [r[:2] for r in rows(vectors.build(v, str(tmp_path / "i")).topk(q, 1, exact=True))] == [(1, 1), (3, 3)]
    assert rows(vectors.build(v.limit(0), str(tmp_path / "j")).topk(q, 1, exact=True)) == []
