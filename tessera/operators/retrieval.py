"""Okapi BM25, vector top-k and reciprocal rank fusion, for many queries at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.config import Settings
from tessera.functions.text import terms

#: Query vectors of a pass over all vectors, and of a matrix product.
PASS, BLOCK = 8192, 128


def postings(items: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, term, tf, len: a row for each item and term."""
    t = items.select(*key, terms(F.col(text)).alias("_t"))
    t = t.select(*key, F.size("_t").alias("len"), F.explode("_t").alias("term"))
    return t.groupBy(*key, "len", "term").agg(F.count("*").cast("long").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf (repeats count)."""
    t = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count("*").cast("long").alias("qtf"))


def bm25(items: DataFrame, queries: DataFrame, key: list[str], scope: list[str] | None = None, cfg: Settings = Settings()) -> DataFrame:
    """query_id, key, bm25_raw for items that hold a term of the query.

    Statistics are those of all items, or of each query's own items when scope is ["query_id"] (then items carry query_id). A term in
    over half of the items has epsilon times the mean idf of the vocabulary; an empty vocabulary gives no rows.
    """
    scope = scope or []
    p = postings(items, [*scope, *(k for k in key if k not in scope)])
    docs = items.select(*scope, F.size(terms(F.col("text"))).alias("len"))
    size = docs.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    df = p.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # the scope's sizes are one row, or one a query
    df = (df.join(size, scope) if scope else df.crossJoin(F.broadcast(size))).withColumn("idf0", idf)
    mean = df.groupBy(*scope).agg(F.avg("idf0").alias("mean_idf"))
    q = query_terms(queries)
    wanted = df.join(F.broadcast(q.select("query_id" if scope else "term", *(["term"] if scope else [])).distinct()), [*scope, "term"], "left_semi")
    wanted = wanted.join(mean, scope) if scope else wanted.crossJoin(F.broadcast(mean))
    wanted = wanted.withColumn("idf", F.when(F.col("idf0") < 0, cfg.epsilon * F.col("mean_idf")).otherwise(F.col("idf0")))
    wanted = wanted.join(q, [*scope, "term"]).select("query_id", "term", "qtf", "idf", "avgdl")
    hit = p.join(wanted, [*scope, "term"])
    score = F.col("qtf") * F.col("idf") * F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("len") / F.col("avgdl")))
    return hit.groupBy("query_id", *(k for k in key if k != "query_id")).agg(F.round(F.sum(score), 9).alias("bm25_raw"))


def ranked(scores: DataFrame, score: str, key: list[str], most: int, out: str) -> DataFrame:
    """The best rows of each query with their rank from 1; ties by key."""
    w = W.Window.partitionBy("query_id").orderBy(F.desc(score), *key)
    return scores.withColumn(out, F.row_number().over(w)).where(F.col(out) <= most)


def bm25_pool(items: DataFrame, queries: DataFrame, key: list[str], most: int, cfg: Settings = Settings()) -> DataFrame:
    """The pool of BM25: when fewer items than the pool's size match, items without a matching term fill it at score 0."""
    s = bm25(items, queries, key, cfg=cfg)
    # no query ranks more than `most` unmatched items, and these are the first by key that it does not match
    per_query = s.groupBy("query_id").count()
    spare = items.select(*key).orderBy(*key).limit(most + int(per_query.agg(F.coalesce(F.max(F.least("count", F.lit(most))), F.lit(0))).first()[0]))
    rest = queries.select("query_id").join(F.broadcast(spare)).join(s, ["query_id", *key], "left_anti").withColumn("bm25_raw", F.lit(0.0))
    return ranked(s.unionByName(rest), "bm25_raw", key, most, "bm25_rank")


def dense_topk(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """query_id, vec_id, similarity, dense_rank: largest dot products of unit vectors. queries (query_id, qvec) may be any number: they
    are worked off in passes of about PASS, each over all vectors; a task keeps the best of its own vectors for each query. Null
    vectors have no similarity."""
    schema = "query_id long, vec_id long, similarity double"
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec")).where("qvec is not null")
    passes = max(1, -(-q.count() // PASS))
    best = None
    for k in range(passes):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).collect()
        near = _nearest([r[0] for r in rows], np.array([r[1] for r in rows]), most)
        part = x.mapInArrow(near, schema)
        best = part if best is None else best.union(part)
    return ranked(best, "similarity", ["vec_id"], most, "dense_rank")


def _nearest(ids: list, qvecs: np.ndarray, most: int):
    """A function over Arrow batches of (vec_id, embedding): the best of all batches for each query."""

    def best(sim: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(sim) > most:
            least = np.partition(sim, len(sim) - most)[len(sim) - most]
            sim, at = sim[sim >= least], at[sim >= least]
        order = np.lexsort((at, -sim))[:most]
        return sim[order], at[order]

    def run(batches):
        import pyarrow as pa

        kept = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        for batch in batches:
            if not (batch.num_rows and ids):
                continue
            at = batch.column(0).to_numpy(zero_copy_only=False)
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for i in range(0, len(ids), BLOCK):
                for j, sim in enumerate(np.round(qvecs[i : i + BLOCK] @ v.T, 9), i):
                    s, a = best(sim, at)
                    kept[j] = best(np.concatenate([kept[j][0], s]), np.concatenate([kept[j][1], a]))
        for q, (sim, at) in zip(ids, kept):
            if len(sim):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(sim), pa.int64()), pa.array(at, pa.int64()), pa.array(sim, pa.float64())], names=["query_id", "vec_id", "similarity"])

    return run


def sparse_cosine(items: DataFrame, queries: DataFrame, key: list[str], most: int) -> DataFrame:
    """The stand-in for a dense encoder: cosine of term-frequency vectors, by a join on terms."""
    p = postings(items, key)
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")))
    length = p.groupBy(*key).agg(norm.alias("norm"))
    q = query_terms(queries)
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qnorm"))
    dot = p.join(F.broadcast(q), "term").groupBy("query_id", *key).agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"))
    s = dot.join(length, key).join(F.broadcast(qn), "query_id")
    return ranked(s.select("query_id", *key, F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 9).alias("similarity")), "similarity", key, most, "dense_rank")


def fuse(dense: DataFrame, lexical: DataFrame, key: list[str], cfg: Settings = Settings()) -> DataFrame:
    """Reciprocal rank fusion by a union and one aggregation: query_id, key, rrf_score, dense_rank, bm25_rank, hit_rank."""
    none = F.lit(None).cast("int")
    both = dense.select("query_id", *key, "dense_rank", none.alias("bm25_rank")).unionByName(lexical.select("query_id", *key, none.alias("dense_rank"), "bm25_rank"))
    g = both.groupBy("query_id", *key).agg(F.max("dense_rank").alias("dense_rank"), F.max("bm25_rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1.0 / (cfg.rrf_k + F.col(c)), F.lit(0.0))
    g = g.withColumn("rrf_score", F.round(part("dense_rank") + part("bm25_rank"), 12))
    w = W.Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), *key)
    return g.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= cfg.top_k)


def census(hits: DataFrame) -> DataFrame:
    """Per query: hits of both rankers, and of either alone; with token_count in hits, also their tokens."""
    d, b = F.col("dense_rank").isNotNull(), F.col("bm25_rank").isNotNull()
    tokens = [F.sum("token_count").cast("long").alias("tokens")] if "token_count" in hits.columns else []
    return hits.groupBy("query_id").agg(F.count_if(d & b).alias("n_both"), F.count_if(d & ~b).alias("n_dense_only"), F.count_if(~d & b).alias("n_bm25_only"), *tokens)


def describe(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_documents"))
