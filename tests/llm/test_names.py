"""Columns with clashing and dotted names, and the law of the shuffle."""

import collections

from pyspark.sql import functions as F

from tessera.llm import ngramjoin, sharding

ODD = ["doc_id", "text", "_u", "_part", "a.b", "row", "_cell", "Shard", "x`y", "rep", "k1", "set"]


def odd(spark, n=12):
    rows = [(i, " ".join(f"w{j}" for j in range(20)) if i < 4 else f"text {i} of its own with many other words {i}", *(f"{c}{i}" for c in ODD[2:])) for i in range(n)]
    return spark.createDataFrame(rows, ODD)


def test_sharding_takes_any_names(spark):
    d = odd(spark)
    out = sharding.shuffle_into_shards(d, 4)
    assert out.columns == [c for c in ODD if c != "Shard"] + ["shard", "slot"]
    kept = sorted(r[0:11] for r in map(tuple, out.collect()))
    assert kept == sorted(tuple(v for c, v in zip(ODD, r) if c != "Shard") for r in map(tuple, d.collect()))
    assert sharding.shuffle_into_shards(d.select("Shard"), 3).columns == ["shard", "slot"]


def test_near_duplicates_take_any_names(spark):
    d = odd(spark)
    out = ngramjoin.keep_one(d)
    assert out.columns == ODD and sorted(r["doc_id"] for r in out.collect()) == [0, *range(4, 12)]
    assert ngramjoin.keep_one(d.limit(0)).count() == 0


def test_law_of_the_shuffle(spark):
    """Rows of each input quarter over shards, and over halves of the slots: chi-square at one in a thousand."""
    d = spark.range(64).withColumnRenamed("id", "doc_id").repartition(4, F.floor(F.col("doc_id") / 16)).cache()
    cells, halves, seeds = collections.Counter(), collections.Counter(), 24
    for seed in range(seeds):
        for r in sharding.shuffle_into_shards(d, 4, seed=seed, per_cell=5).collect():
            cells[r["doc_id"] // 16, r["shard"]] += 1
            halves[r["doc_id"] // 16, r["slot"] // 8] += 1
    chi = lambda c, n: sum((c[k] - seeds * 64 / n) ** 2 / (seeds * 64 / n) for k in c)
    assert len(cells) == 16 and chi(cells, 16) < 27.9  # 9 degrees of freedom
    assert len(halves) == 8 and chi(halves, 8) < 16.3  # 3
