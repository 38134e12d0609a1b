"""The learned encoder against a dense decomposition."""

import random

import numpy as np
from conftest import rows

from tessera.operators import encoder


def corpus(n=80):
    rng = random.Random(3)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("sun", "car", "tree", "code")]
    return [(f"d{i:02}", " ".join(rng.choice(topics[i % 4]) if rng.random() < 0.8 else rng.choice(sum(topics, [])) for _ in range(40))) for i in range(n)]


def dense(texts, idf):
    a = np.zeros((len(texts), len(idf)))
    for i, t in enumerate(texts):
        at, w = encoder._sparse(t, idf)
        a[i, at] = w
    return a


def test_equals_a_dense_decomposition(spark):
    docs = corpus()
    d = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    e = encoder.fit(d, ["doc_id"], dims=6, features=256, rounds=8)
    assert np.allclose(e.directions.T @ e.directions, np.eye(6), atol=1e-9)
    a = dense([t for _, t in docs], e.idf)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(e.values, want[:6], rtol=1e-3)
    left = np.linalg.norm(a - a @ e.directions @ e.directions.T)
    assert left <= 1.001 * np.sqrt((want[6:] ** 2).sum())  # no better rank-six approximation
    got = {r["doc_id"]: np.array(r["embedding"]) for r in e.encode(d, ["doc_id"]).collect()}
    y = a @ e.directions
    assert all(np.allclose(got[k], y[i] / np.linalg.norm(y[i]), atol=1e-5) for i, (k, _) in enumerate(docs))


def test_topics_are_near(spark):
    docs = corpus()
    d = spark.createDataFrame(docs, "doc_id string, text string")
    e = encoder.fit(d, ["doc_id"], dims=4, features=512)
    v = np.array([r["embedding"] for r in e.encode(d, ["doc_id"]).orderBy("doc_id").collect()])
    sim = v @ v.T - 2 * np.eye(len(v))
    assert (sim.argmax(axis=1) % 4 == np.arange(len(v)) % 4).mean() > 0.95


def test_all_items_are_decomposed(spark):
    rng = random.Random(5)
    docs = [(f"d{i}", " ".join(rng.choices(("sun", "car", "tree", "code", "rain", "road"), (9, 7, 5, 4, 2, 1), k=4))) for i in range(24_000)]
    e = encoder.fit(spark.createDataFrame(docs, "doc_id string, text string").repartition(5), ["doc_id"], dims=4, features=64, rounds=8)
    a = dense([x for _, x in docs], e.idf)
    want = np.linalg.svd(a.T @ a, compute_uv=False)[:4]
    assert np.allclose(e.values**2, want, rtol=1e-3)  # the squares of 20,000 rows add up to a sixth less


def test_sample_and_odd_rows(spark):
    docs = [*corpus(), (None, None), ("e", ""), ("x", "!?"), ("twin", "sun1 sun2"), ("twin", "sun1 sun2")]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    e = encoder.fit(d, ["doc_id"], dims=4, features=256, sample=30)
    assert e.directions.shape == (256, 4) and np.isfinite(e.directions).all()
    got = rows(e.encode(d, ["doc_id"]))
    assert len(got) == len(docs) and sum(v is None for _, v in got) == 3
    none = encoder.fit(d.limit(0), ["doc_id"], dims=4, features=256)
    assert {r["embedding"] for r in none.encode(d, ["doc_id"]).collect()} == {None}
