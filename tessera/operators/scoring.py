"""Relevance of candidate sentences: lexical and cross-encoder signals, normalised and blended, with a score cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.config import Settings
from tessera.functions.text import cache_key, sigmoid
from tessera.operators.retrieval import bm25


def min_max(value: str, by: str = "query_id") -> Column:
    """value scaled to 0..1 within each query; 0 where all are equal."""
    w = W.Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < 1e-12, F.lit(0.0)).otherwise((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)))


def overlap_logit(a: float = 8.0, b: float = 4.0, c: float = 4.0):
    """The stand-in for a cross-encoder: a logit from term cosine and the share of query terms covered."""

    def score(query_terms: Column, text_terms: Column) -> Column:
        q, t = F.array_distinct(query_terms), F.array_distinct(text_terms)
        common = F.size(F.array_intersect(q, t)).cast("double")
        n, m = F.size(q).cast("double"), F.size(t).cast("double")
        return F.when((n > 0) & (m > 0), a * common / F.sqrt(n * m) + b * common / n - c)

    return score


def score(candidates: DataFrame, queries: DataFrame, cfg: Settings = Settings(), ce: Column | None = None) -> DataFrame:
    """candidates (query_id, sid, text, ...) with bm25_raw, bm25_norm, ce_raw, ce_norm and relevance. BM25 is fitted on each query's own
    candidates. ce: the column of the cross-encoder's logit; left out, or with weight 0, it is null and counts 0."""
    w_ce, w_bm = cfg.weights()
    s = bm25(candidates, queries, ["query_id", "sid"], ["query_id"], cfg)
    out = candidates.join(s, ["query_id", "sid"], "left").withColumn("bm25_raw", F.coalesce("bm25_raw", F.lit(0.0)))
    out = out.withColumn("ce_raw", ce if ce is not None and w_ce > 0 else F.lit(None).cast("double"))
    out = out.withColumn("ce_norm", F.coalesce(sigmoid(F.col("ce_raw")), F.lit(0.0))).withColumn("bm25_norm", min_max("bm25_raw"))
    return out.withColumn("relevance", F.round(w_ce * F.col("ce_norm") + w_bm * F.col("bm25_norm"), 9))


def probe_cache(rows: DataFrame, cache: DataFrame, model: str, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their key k and cached value v or null, the distinct keys and parts that the cache lacks)."""
    keyed = rows.withColumn("k", cache_key(F.lit(model), *(F.col(p) for p in parts)))
    one = cache.groupBy("k").agg(F.min("v").alias("v"))  # a key that was stored twice counts once
    hit = keyed.join(one, "k", "left")
    return hit, keyed.select("k", *parts).dropDuplicates(["k"]).join(one.select("k"), "k", "left_anti")


def cache_stats(probed: DataFrame, by: str = "query_id") -> DataFrame:
    """Hits and misses of each query, counted per occurrence."""
    return probed.groupBy(by).agg(F.count_if(F.col("v").isNotNull()).alias("hits"), F.count_if(F.col("v").isNull()).alias("misses"))
