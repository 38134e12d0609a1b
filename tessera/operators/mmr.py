"""Greedy maximal marginal relevance within each query."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions.text import terms

ADDED = "mmr_score double, mmr_rank int, redundant_with string, similarity double, drop_reason string"


def unit_rows(bags: list) -> np.ndarray:
    """Term-frequency vectors of unit length, as a dense matrix over the candidates' own terms."""
    ids: dict[str, int] = {}
    counts = [Counter(ids.setdefault(t, len(ids)) for t in (b if b is not None else ())) for b in bags]
    m = np.zeros((len(bags), max(1, len(ids))))
    for i, c in enumerate(counts):
        m[i, list(c)] = list(c.values())
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def dense_rows(vectors: list) -> np.ndarray:
    """Vectors of unit length as a matrix; one that is null is similar to nothing."""
    width = max((len(v) for v in vectors if v is not None), default=1)
    m = np.array([np.zeros(width) if v is None else np.asarray(v, float) for v in vectors])
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def greedy(relevance: np.ndarray, vectors: np.ndarray, lam: float, limit: float) -> list[tuple[int, float | None, int, float, bool]]:
    """(candidate, score, nearest chosen one or -1, similarity to it, dropped) in the order of choice, then of drops. The candidate that
    comes next is dropped, not skipped over, when it is `limit` similar to a chosen one; ties go to the least index."""
    n = len(relevance)
    open_, near, sim = np.ones(n, bool), np.full(n, -1), np.zeros(n)
    kept, dropped = [], []
    while open_.any():
        value = relevance if not kept else np.round(lam * relevance - (1 - lam) * sim, 12)
        i = int(np.argmax(np.where(open_, value, -np.inf)))
        open_[i] = False
        if kept and sim[i] >= limit - 1e-12:
            dropped.append((i, float(value[i]), int(near[i]), float(sim[i]), True))
            continue
        kept.append((i, float(value[i]), int(near[i]), float(sim[i]), False))
        s = np.round(vectors @ vectors[i], 12)
        closer = open_ & (s > sim)
        sim[closer], near[closer] = s[closer], i
    return kept + dropped


def mmr(scored: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """scored (query_id, sid, text, cand_idx, relevance, ...) with mmr_score, mmr_rank, redundant_with, similarity and drop_reason.
    Similarity is the cosine of the column embedding where there is one, else that of term frequencies.

    A query's candidates are the sentences of its top_k chunks, so that a group is small whatever the corpus.
    """
    lam, limit = cfg.mmr_lambda, cfg.duplicate_similarity
    dense = "embedding" in scored.columns
    slim = scored.select("query_id", "sid", "cand_idx", "relevance", F.col("embedding") if dense else terms(F.col("text")).alias("bag"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cand_idx", kind="stable")
        sids = g["sid"].tolist()
        rows = []
        for rank, (i, value, near, sim, gone) in enumerate(greedy(g["relevance"].to_numpy(float), (dense_rows(g["embedding"].tolist()) if dense else unit_rows(g["bag"].tolist())), lam, limit), 1):
            other = sids[near] if near >= 0 else None
            rows.append((g["query_id"].iloc[0], sids[i], value, rank, other, sim if other else 0.0, f"redundant with {other} (sim {sim:.2f})" if gone else None))
        return pd.DataFrame(rows, columns=["query_id", "sid", "mmr_score", "mmr_rank", "redundant_with", "similarity", "drop_reason"])

    kind = scored.schema["query_id"].dataType.simpleString()
    found = slim.groupBy("query_id").applyInPandas(one, f"query_id {kind}, sid string, {ADDED}")
    return scored.join(found, ["query_id", "sid"])
