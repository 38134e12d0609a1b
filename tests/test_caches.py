"""Caches: what is computed, kept and read; redundancy judged by cached vectors."""

import glob

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import text as tx
from tessera.operators import chunking, encoder, mmr, scoring
from tessera.plans.compress import compress, embedder
from tessera.sources.caches import Cache, hit_counts, vector_cache


def lengths(calls):
    def compute(lacking):
        calls.append(sorted(r["text"] for r in lacking.collect()))
        return lacking.select("k", F.when(F.col("text") != "", F.length("text")).alias("value"))

    return compute


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_each_text_is_computed_once(spark, tmp_path):
    cache, calls = Cache(spark, str(tmp_path / "c")), []
    got = cache.through(table(spark, "aa", "b", "aa", None, ""), "m", ["text"], lengths(calls))
    assert rows(got) == sorted([(0, "aa", 2.0, False), (1, "b", 1.0, False), (2, "aa", 2.0, False), (3, None, None, None), (4, "", None, False)], key=repr)
    got = cache.through(table(spark, "b", "", "ccc", "b"), "m", ["text"], lengths(calls))
    assert rows(got) == sorted([(0, "b", 1.0, True), (1, "", None, True), (2, "ccc", 3.0, False), (3, "b", 1.0, True)], key=repr)
    other = cache.through(table(spark, "b"), "n", ["text"], lengths(calls))  # another model
    assert rows(other) == [(0, "b", 1.0, False)] and calls == [["", "aa", "b"], ["ccc"], ["b"]]
    assert rows(hit_counts(got, ["text"])) == sorted([("b", 2, 0), ("", 1, 0), ("ccc", 0, 1)], key=repr)
    empty = cache.through(table(spark, "x").limit(0), "m", ["text"], lengths(calls))
    assert rows(empty) == [] and cache.entries().count() == 5


def test_keys_are_those_of_the_score_cache(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"))
    x = spark.createDataFrame([("q", "t")], "query string, text string")
    cache.through(x, "m", ["query", "text"], lambda lacking: lacking.select("k", F.lit(0.5).alias("value")))
    assert cache.entries().first()["k"] == x.select(tx.cache_key(F.lit("m"), F.col("query"), F.col("text"))).first()[0]
    hit, miss = scoring.probe_cache(x, cache.entries(), "m", ["query", "text"])
    assert hit.first()["v"] == 0.5 and miss.count() == 0


def test_few_partitions_are_read_and_repeats_go(spark, tmp_path):
    folder, calls = str(tmp_path / "c"), []
    cache = Cache(spark, folder)
    cache.through(table(spark, *(f"text {i}" for i in range(300))), "m", ["text"], lengths(calls))
    assert 100 < len(glob.glob(f"{folder}/shard=*")) <= 256
    shard = cache.entries().where("k is not null").first()["shard"]
    plan = cache.entries().where(F.col("shard").isin([shard]))._jdf.queryExecution().executedPlan().toString()
    assert f"= {shard})" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    cache.entries().write.mode("append").partitionBy("shard").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).select("k", "v", "shard").where(F.col("shard") == shard).write.mode("append").partitionBy("shard").parquet(folder)
    extra = cache.entries().count() - 300
    again = cache.through(table(spark, *(f"text {i}" for i in range(300))), "m", ["text"], lengths(calls))
    assert again.count() == 300 and again.where("hit").count() == 300 and calls[1] == []
    assert extra > 0 and cache.compact() == extra and cache.entries().count() == 300 and cache.compact() == 0


def test_redundancy_by_cached_vectors(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    text = "\n\n".join(f"The {words[i % 6]} report number {i} names {words[(i * i) % 6]} and {words[(i + 2) % 6]} again." for i in range(40))
    docs = spark.createDataFrame([("a", text), ("b", text[:700])], "doc_id string, text string")
    cfg = Settings(chunk_tokens=80, budget=300)
    chunks = chunking.chunks(docs, cfg)
    model, cache = encoder.fit(docs, ["doc_id"], dims=8, features=256), vector_cache(spark, str(tmp_path / "v"))
    q = spark.createDataFrame([(1, "alpha report"), (2, "gamma and delta")], "query_id long, query string")
    one = compress(chunks, q, cfg, embed=embedder(model, "svd", cache))
    kept = cache.entries().count()
    two = compress(chunks, q, cfg, embed=embedder(model, "svd", cache))
    assert rows(one.summary) == rows(two.summary) and kept == cache.entries().count() == one.sentences.select("text").distinct().count()
    # against the greedy choice over the vectors themselves
    vectors = {r["text"]: r["embedding"] for r in model.encode(one.sentences.select("text").distinct().withColumn("k", F.lit(1)), ["k", "text"]).collect()}
    for query in (1, 2):
        s = sorted(one.sentences.where(F.col("query_id") == query).collect(), key=lambda r: r["cand_idx"])
        v = mmr.dense_rows([vectors[r["text"]] for r in s])
        order = mmr.greedy(np.array([r["relevance"] for r in s]), v, cfg.mmr_lambda, cfg.duplicate_similarity)
        assert [s[i]["mmr_rank"] for i, *_ in order] == list(range(1, len(s) + 1))
    assert (mmr.dense_rows([None, [3.0, 4.0]]) == np.array([[0, 0], [0.6, 0.8]])).all()
