"""The whole compression of many queries: retrieve, decompose, score, suppress, select, assemble."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions.text import terms
from tessera.operators import assemble, chunking, encoder, lexical, metrics, mmr, retrieval, scoring, selection
from tessera.operators.lexical import LexicalIndex
from tessera.plans.lineage import bounded, cut, delete, fresh_dir
from tessera.sources.caches import Cache

KEY = ["doc_id", "chunk_id"]
Embed = Callable[[DataFrame], DataFrame]


@dataclass
class Compression:
    hits: DataFrame
    sentences: DataFrame
    contexts: DataFrame
    summary: DataFrame


def retrieve(chunks: DataFrame, queries: DataFrame, cfg: Settings = Settings(), index: LexicalIndex | None = None) -> DataFrame:
    """The fused hits of each query, with text and token_count, from the chunks' lexical index; without one, it is made for the call."""
    hits = fused(chunks, queries, KEY, cfg, index)
    return chunks.join(bounded(hits), KEY)  # top_k rows a query


def fused(items: DataFrame, queries: DataFrame, key: list[str], cfg: Settings = Settings(), index: LexicalIndex | None = None, dense: DataFrame | None = None) -> DataFrame:
    """query_id, key, rrf_score, dense_rank, bm25_rank, hit_rank of the best items by both rankers. dense (query_id, key, dense_rank):
    the pool of a dense encoder; by default that of term-frequency cosines."""

    def search(index: LexicalIndex) -> DataFrame:
        return retrieval.fuse(index.cosine(queries, cfg.pool()) if dense is None else dense, index.bm25(queries, cfg.pool(), zero=True, cfg=cfg), key, cfg)

    return cut(search(index)) if index is not None else searched(items, key, search)


def searched(items: DataFrame, key: list[str], search: Callable[[LexicalIndex], DataFrame]) -> DataFrame:
    """What search finds in an index of items that lasts as long as the search."""
    spark = items.sparkSession
    folder = fresh_dir(spark, "lexical")
    try:
        return cut(search(lexical.build(items, key, folder)))
    finally:
        delete(spark, folder)


def decompose(hits: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The candidate sentences of each query, exact repeats removed, in canonical order."""
    # a chunk that several queries hit is cut into sentences once
    units = chunking.sentence_units(hits.select("doc_id", "chunk_id", "char_offset", "text").dropDuplicates(["doc_id", "chunk_id"]), cfg)
    units = units.join(hits.select("query_id", "doc_id", "chunk_id", "hit_rank"), ["doc_id", "chunk_id"])
    return chunking.with_order(chunking.exact_dedup(units, ["query_id"]), ["query_id"])


def relevance(candidates: DataFrame, queries: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    with_query = candidates.join(bounded(queries.select("query_id", "query")), "query_id")
    ce = scoring.overlap_logit()(terms(F.col("query")), terms(F.col("text"))) if cfg.weight_cross > 0 else None
    return scoring.score(with_query, queries, cfg, ce)


def compress(chunks: DataFrame, queries: DataFrame, cfg: Settings = Settings(), index: LexicalIndex | None = None, embed: Embed | None = None) -> Compression:
    """queries: query_id, query and perhaps budget. Every query stays in the summary, also without hits or survivors. embed adds the
    column embedding to the scored candidates, by which redundancy is then judged."""
    hits = cut(retrieve(chunks, queries, cfg, index))
    scored = relevance(cut(decompose(hits, cfg)), queries, cfg)
    ranked = cut(mmr.mmr(scored if embed is None else cut(embed(scored)), cfg).drop("embedding"))
    return finish(hits, ranked, queries, cfg)


def embedder(model: encoder.Encoder, name: str, cache: Cache) -> Embed:
    """Vectors of a learned encoder by way of a cache; name stands for the model in the cache's keys."""

    def embed(candidates: DataFrame) -> DataFrame:
        compute = lambda lacking: model.encode(lacking, ["k"]).withColumnRenamed("embedding", "value")
        return cache.through(candidates, name, ["text"], compute).withColumnRenamed("value", "embedding").drop("hit")

    return embed


def finish(hits: DataFrame, ranked: DataFrame, queries: DataFrame, cfg: Settings = Settings()) -> Compression:
    """Selection and all that follows, for candidates that are scored and ranked."""
    if "budget" in queries.columns:
        ranked = ranked.join(bounded(queries.select("query_id", "budget")), "query_id")
    chosen = cut(selection.select(ranked, cfg))
    shown = assemble.stripped(chosen.where("selected"), cfg)
    contexts = assemble.compressed(shown, ["query_id"], cfg)
    base = assemble.baseline(hits)
    tokens = hits.groupBy("query_id").agg(F.sum("token_count").cast("long").alias("retrieved_tokens"), F.count("*").alias("n_hits"))
    kept = chosen.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.count_if("selected").alias("n_kept"), F.sum(F.when(F.col("selected"), F.col("token_count")).otherwise(0)).cast("long").alias("selected_tokens"))
    s = queries.select("query_id")
    for part in (tokens, kept, contexts, base.withColumnRenamed("context", "baseline_context"), assemble.strip_savings(shown, ["query_id"], cfg)):
        s = s.join(part, "query_id", "left")
    s = s.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("baseline_context", F.coalesce("baseline_context", F.lit("")))
    s = s.withColumn("compressed_context_tokens", cfg.counter.column(F.col("context")).cast("long")).withColumn("baseline_context_tokens", cfg.counter.column(F.col("baseline_context")).cast("long"))
    s = s.withColumn("tokens_saved", F.col("baseline_context_tokens") - F.col("compressed_context_tokens"))
    s = s.withColumn("compression_ratio", F.round(metrics.ratio(F.col("baseline_context_tokens"), F.col("compressed_context_tokens")), 6))
    s = s.na.fill(0, ["n_hits", "n_candidates", "n_kept", "selected_tokens", "retrieved_tokens"]).withColumn("token_counter", F.lit(cfg.counter.name))
    return Compression(hits, chosen, s.select("query_id", "baseline_context", "context"), s.drop("context", "baseline_context"))


def sweep(ranked: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Tokens and sentences selected of each query under each budget; a null budget is unlimited."""
    budgets = F.explode(F.array(*(F.lit(b).cast("int") for b in cfg.sweep)))
    every = selection.select(ranked.withColumn("budget", budgets).withColumn("_b", F.coalesce("budget", F.lit(-1))), cfg, ["query_id", "_b"])
    return every.groupBy("query_id", "budget").agg(F.count_if("selected").alias("n_kept"), F.sum(F.when(F.col("selected"), F.col("token_count")).otherwise(0)).cast("long").alias("selected_tokens"))
