"""The written lexical index against brute force, and what its bounds leave out."""

import collections
import math
import random
import re

import pytest
from conftest import rows

from tessera.operators import lexical, retrieval

ITEMS = "doc_id string, chunk_id int, text string, bucket int, term string, lens int"


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["common"] * 30 + ["Rare9"]
    return [(f"d{i % 37}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) if i % 11 else [None, "", "?!"][i % 3], i % 5, "t", 1) for i in range(n)]


def brute(items, queries, most, zero=False, k1=1.5, b=0.75, eps=0.25):
    toks = {(d, c): re.findall("[a-z0-9]+", (t or "").lower()) for d, c, t, *_ in items}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = collections.Counter(t for x in toks.values() for t in set(x))
    idf0 = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf0.values()) / len(idf0)
    out = []
    for q, text in queries:
        scored = []
        for k, x in toks.items():
            c = collections.Counter(x)
            hit = [t for t in re.findall("[a-z0-9]+", (text or "").lower()) if t in c]
            if hit or zero:
                s = sum((idf0[t] if idf0[t] >= 0 else eps * mean) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(x) / avg)) for t in hit)
                scored.append((-round(s, 6), k))
        out += [(q, *k, -s + 0.0, r + 1) for r, (s, k) in enumerate(sorted(scored)[:most])]
    return sorted(out, key=repr)


def found(df, score="bm25_raw", rank="bm25_rank"):
    return sorted(((r["query_id"], r["doc_id"], r["chunk_id"], round(r[score], 6) + 0.0, r[rank]) for r in df.collect()), key=repr)


QUERIES = [(1, "w1 w2 w2 common"), (2, "rare9"), (3, "common"), (4, "unseen"), (5, ""), (6, None), (7, "w3 common rare9 w4")]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_ITEMS", 9)


@pytest.mark.parametrize("few", [0, 64])
@pytest.mark.parametrize("most", [1, 4, 1000])
def test_bm25_equals_brute_force(spark, tmp_path, monkeypatch, small, few, most):
    monkeypatch.setattr(lexical, "FEW_TERMS", few)
    items = corpus()
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = lexical.build(spark.createDataFrame(items, ITEMS).repartition(3), ["doc_id", "chunk_id"], str(tmp_path / "i"))
    assert found(index.bm25(q, most)) == brute(items, QUERIES, most)
    assert found(index.bm25(q, most, zero=True)) == brute(items, QUERIES, most, zero=True)


def test_passes_and_ties(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(lexical, "PASS", 2)
    items = [(f"d{i:02}", i % 3, "same words", 0, "", 0) for i in range(50)]
    q = spark.createDataFrame([(i, "same") for i in range(7)], "query_id long, query string")
    index = lexical.build(spark.createDataFrame(items, ITEMS).repartition(4), ["doc_id", "chunk_id"], str(tmp_path / "i"))
    assert found(index.bm25(q, 5)) == brute(items, [(i, "same") for i in range(7)], 5)


def test_cosine_equals_the_join(spark, tmp_path, small):
    items = spark.createDataFrame(corpus(4), ITEMS)
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = lexical.build(items, ["doc_id", "chunk_id"], str(tmp_path / "i"))
    want = retrieval.sparse_cosine(items, q, ["doc_id", "chunk_id"], 6)
    assert found(index.cosine(q, 6), "similarity", "dense_rank") == found(want, "similarity", "dense_rank")


def test_bounds_leave_segments_out(spark, tmp_path, small):
    rare = {3: 40, 60: 3, 61: 2}  # items that hold the rare word, and how often
    items = [(f"d{i:03}", 0, f"u{i} " + "common word " * (i % 4 + 1) + "rare9 " * rare.get(i, 0), i // 9, "", 0) for i in range(180)]
    from pyspark.sql import functions as F

    index = lexical.build(spark.createDataFrame(items, ITEMS), ["doc_id", "chunk_id"], str(tmp_path / "i"), F.col("bucket"))
    q = spark.createDataFrame([(1, "rare9 common")], "query_id long, query string")
    assert found(index.bm25(q, 1)) == brute(items, [(1, "rare9 common")], 1)
    part = next(index._passes(q))
    s = spark.read.parquet(f"{tmp_path}/i/stats").first()
    from tessera.config import Settings

    w = index._weights(part, s, Settings())
    kept = index._bounded(part, w, lexical._bm25(s["avgdl"], Settings()), 1)
    assert 1 <= kept.count() < index.segments().where("kind = 'items'").count() == 20


def test_replacing_buckets(spark, tmp_path, small):
    from pyspark.sql import functions as F

    items = corpus(8)
    folder = str(tmp_path / "i")
    lexical.build(spark.createDataFrame(items, ITEMS), ["doc_id", "chunk_id"], folder, F.col("bucket"))
    first = lexical.LexicalIndex(spark, folder).stats().first()["n"]
    new = [x if x[3] != 2 else (x[0], x[1], "w1 fresh " + (x[2] or ""), 2, "", 0) for x in items if x[3] != 2 or x[1] % 2]
    index = lexical.replace(spark.createDataFrame([x for x in new if x[3] == 2], ITEMS), ["doc_id", "chunk_id"], folder, F.col("bucket"))
    asked = [(1, "fresh w1"), (2, "w5 common")]
    q = spark.createDataFrame(asked, "query_id long, query string")
    assert found(index.bm25(q, 8)) == brute(new, asked, 8) and index.stats().first()["n"] < first
    gone = lexical.replace(spark.createDataFrame([], ITEMS), ["doc_id", "chunk_id"], folder, F.col("bucket"), spark.createDataFrame([(2,), (4,)], "bucket int"))
    assert found(gone.bm25(q, 8)) == brute([x for x in new if x[3] not in (2, 4)], asked, 8)


def test_index_of_nothing(spark, tmp_path):
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = lexical.build(spark.createDataFrame([], ITEMS), ["doc_id", "chunk_id"], str(tmp_path / "i"))
    assert rows(index.bm25(q, 3)) == [] and rows(index.cosine(q, 3)) == []
    only = lexical.build(spark.createDataFrame([("a", 1, None, 0, "", 0)], ITEMS), ["doc_id", "chunk_id"], str(tmp_path / "j"))
    assert rows(only.bm25(q, 3)) == [] and len(rows(only.bm25(q, 3, zero=True))) == 7


def test_scores_round_as_their_sql_does(spark):
    import duckdb
    from pyspark.sql import functions as F

    from tessera.functions.text import rounded

    x = [133.0332695, 65.5557985, 66.6275705, 101.8064325, -133.0332695, 0.0, 7.25]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(rounded(F.col("v"), 6)).collect()]
    assert got == [duckdb.sql(f"select round({v}::double, 6)").fetchall()[0][0] for v in x]
    assert got[0] == 133.033269  # by its decimal digits it would go up
