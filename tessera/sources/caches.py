"""Caches of computed values by key: scores of pairs of texts, vectors of texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import cache_key
from tessera.plans.lineage import bounded, cut

#: Key prefixes of the two kinds of cache (fixed values).
SCORES, VECTORS = "s:", "e:"
SHARDS, VALUES = 256, 50_000


@dataclass(frozen=True)
class Cache:
    """Rows (k, v) below folder, partitioned by the first byte of the key's digest, so that a look-up of few keys reads few partitions.

    What is looked up and lacking is computed once for each different key and added. A run that fails between computing and adding, or
    that adds what another one adds too, leaves a key twice or not at all: either is harmless, and compact() takes repeats out.
    """

    spark: SparkSession
    folder: str
    kind: str = "double"
    prefix: str = SCORES

    def key(self, model: str, parts: list[str]):
        digest = F.substring(cache_key(F.lit(model), *(F.col(f"`{p}`").cast("string") for p in parts)), 3, 64)
        return F.concat(F.lit(self.prefix), digest)

    def entries(self) -> DataFrame:
        """All rows: k, v, shard."""
        path, schema = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder), f"k string, v {self.kind}, shard string"
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder)

    def through(self, rows: DataFrame, model: str, parts: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows with value and hit: whether the cache held it before. compute gets the distinct (k, parts...) that it lacks and returns
        (k, value), once for each k. Rows with a null part have no value and are neither hit nor miss (null). A computed null is kept."""
        keyed = rows.withColumn("_k", self.key(model, parts))
        want = cut(keyed.where("_k is not null").select(F.col("_k").alias("k"), *(F.col(f"`{p}`") for p in parts)).dropDuplicates(["k"]))
        shards = [r[0] for r in want.select(_shard("k")).distinct().collect()]  # 256 at most
        asked = self.entries().where(F.col("shard").isin(shards)) if shards else self.entries().limit(0)
        have = cut(asked.join(bounded(want.select("k")), "k", "left_semi").groupBy("k").agg(F.min("v").alias("v")))
        fresh = compute(want.join(bounded(have.select("k")), "k", "left_anti"))
        made = cut(fresh.select("k", F.col("value").cast(self.kind).alias("v")))
        made.withColumn("shard", _shard("k")).repartition("shard").write.mode("append").partitionBy("shard").parquet(self.folder)
        values = have.withColumn("hit", F.lit(True)).unionByName(made.withColumn("hit", F.lit(False)))
        values = values.select(F.col("k").alias("_k"), F.col("v").alias("value"), "hit")
        return keyed.join(bounded(values, VALUES), "_k", "left").drop("_k")

    def compact(self) -> int:
        """Takes repeated keys out, shard by shard where there are any; how many rows went."""
        n = F.count("*").alias("n")
        twice = cut(self.entries().groupBy("shard", "k").agg(n).where("n > 1").groupBy("shard").agg(F.sum(F.col("n") - 1).alias("n")))
        found = {r["shard"]: r["n"] for r in twice.collect()}
        if found:
            some = self.entries().where(F.col("shard").isin(list(found)))
            one = cut(some.groupBy("k", "shard").agg(F.min("v").alias("v")).select("k", "v", "shard"))
            one.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.folder)
        return sum(found.values())


def _shard(key: str):
    return F.concat(F.lit("x"), F.substring(key, 3, 2)).alias("shard")


def vector_cache(spark: SparkSession, folder: str) -> Cache:
    return Cache(spark, folder, "array<float>", VECTORS)


def hit_counts(through: DataFrame, by: list[str]) -> DataFrame:
    """Hits and misses of each group, counted per occurrence."""
    return through.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
