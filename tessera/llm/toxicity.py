"""Toxic passages as maximal scoring segments over token log-odds.

Training: document counts of words and word beginnings by class; log-odds under an informative Dirichlet prior, kept where their
z-score is significant. Scoring: every other token has one negative score, and a linear scan finds all maximal scoring segments
(Ruzzo and Tompa). A segment's score becomes an expected number of such segments by chance in a clean text of that length
(Karlin and Altschul: K n exp(-lambda S)), significant segments add up, and a logistic curve fitted on training rows turns the
sum into the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, crc_mod, spare, table, typed

#: Labelled rows of either class that training reads at most: those of the least hashes of the id.
SAMPLE_PER_CLASS = 10_000
#: Features that the model keeps at most: those of the largest z-scores.
MAX_FEATURES = 50_000
#: Texts of training rows give each word and its beginnings of these lengths.
PREFIXES = (4, 5, 6)
MIN_Z, MIN_DELTA, MIN_DOCS, PRIOR_SHARE, K, SIGNIFICANT = 3.0, 2.0, 4, 0.25, 0.1, 0.05
TOKEN = re.compile(r"\w+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    background: float = -0.05
    lam: float = 1.0
    a: float = -2.0
    b: float = 0.5


class _Scores(dict):
    """token -> score, worked out once; forgets all when large."""

    def __init__(self, model: Model):
        super().__init__()
        self.m = model

    def __missing__(self, word: str) -> float:
        w = self.m.weights
        s = w.get(word)
        if s is None:
            for n in reversed(PREFIXES):
                if len(word) > n and (s := w.get(f"{word[:n]}*")) is not None:
                    break
            else:
                s = self.m.background
        if len(self) > 500_000:
            self.clear()
        self[word] = s
        return s


def maximal_segments(hits: list[tuple[int, float]], n: int, background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of n tokens of which `hits` (place, positive score) are given and the others
    score `background` < 0, in time linear in the hits."""
    segs: list[tuple[int, int, float, float]] = []  # first, end, cumulative before, cumulative after
    total, at = 0.0, 0
    for place, score in hits:
        total += (place - at) * background
        seg = (place, place + 1, total, total + score)
        total, at = total + score, place + 1
        while True:
            j = len(segs) - 1
            while j >= 0 and segs[j][2] >= seg[2]:
                j -= 1
            if j < 0 or segs[j][3] >= seg[3]:
                segs.append(seg)
                break
            seg = (segs[j][0], seg[1], segs[j][2], seg[3])
            del segs[j:]
    return [(a, b, r - l) for a, b, l, r in segs]


def features(text: str) -> set[str]:
    out = set()
    for w in set(TOKEN.findall(text.lower())):
        out.add(w)
        out.update(f"{w[:n]}*" for n in PREFIXES if len(w) > n)
    return out


def passages(text: str, model: Model, scores: dict | None = None) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's statistic and its significant passages (first token, end token, log10 of the expected number by chance)."""
    scores = scores if scores is not None else _Scores(model)
    tokens = TOKEN.findall(text.lower())
    n = max(1, len(tokens))
    hits = [(i, s) for i, s in enumerate(map(scores.__getitem__, tokens)) if s > 0]
    base = math.log(K * max(n, 1 / K))
    found = [(a, b, base - model.lam * s) for a, b, s in maximal_segments(hits, n, model.background)]
    if not found:
        return -base, []
    keep = [x for x in found if -math.expm1(-math.exp(min(50.0, x[2]))) < SIGNIFICANT]
    best = -min(x[2] for x in found)
    return (sum(-x[2] for x in keep) if keep else best), [(a, b, e / math.log(10)) for a, b, e in keep]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"]):
            seen[int(toxic)].update(features(text or ""))
        if sum(map(len, seen)) > 400_000:
            yield _counted(seen)
            seen = Counter(), Counter()
    if any(seen):  # a frame without rows has no string column
        yield _counted(seen)


def _counted(seen: tuple[Counter, Counter]) -> pd.DataFrame:
    keys = list(seen[1].keys() | seen[0].keys())
    return pd.DataFrame({"feature": keys, "t": [seen[1][k] for k in keys], "c": [seen[0][k] for k in keys]}).astype({"t": "int64", "c": "int64"})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learns from labelled rows whose crc32 of the id modulo 3 is not 1. Repeated labels of an id count as toxic if any is; null
    labels and ids don't count. Without rows of both classes the model finds nothing toxic."""
    lab = typed(labels, "doc_id long, toxic int").where("doc_id is not null and toxic is not null").where(crc_mod("doc_id", 3) != 1)
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [lab.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(some[0].union(some[1]))  # 2 * per_class rows of two numbers at most
    train = typed(docs, "doc_id long, text string").join(sample, "doc_id")
    counts = train.select("text", "toxic").mapInPandas(_count, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    kind = F.col("feature").endswith("*")
    counts = counts.withColumn("n", F.when(kind, F.substring_index("feature", "*", 1)).otherwise(F.lit("")))
    counts = counts.withColumn("kind", F.when(kind, F.length("n")).otherwise(0)).drop("n")
    counts = checkpoint(counts)
    total = {r["kind"]: (r["t"], r["c"]) for r in counts.groupBy("kind").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()}
    if not total or not total.get(0, (0, 0))[0] or not total[0][1]:
        return Model()
    z = []
    for k, (nt, nc) in total.items():
        if not nt or not nc:
            continue
        # prior: PRIOR_SHARE of the toxic count, dealt out by the word's share of both classes
        a0 = PRIOR_SHARE * nt
        alpha = F.lit(a0 / (nt + nc)) * (F.col("t") + F.col("c"))
        delta = F.log((F.col("t") + alpha) / F.greatest(nt + a0 - F.col("t") - alpha, F.lit(1e-9))) - F.log((F.col("c") + alpha) / F.greatest(nc + a0 - F.col("c") - alpha, F.lit(1e-9)))
        sd = F.sqrt(1 / (F.col("t") + alpha) + 1 / (F.col("c") + alpha))
        z.append(counts.where((F.col("kind") == k) & (F.col("t") >= MIN_DOCS)).select("feature", "kind", "t", "c", delta.alias("delta"), (delta / sd).alias("z")))
    every = z[0]
    for x in z[1:]:
        every = every.union(x)
    kept = every.where((F.col("z") >= MIN_Z) & (F.col("delta") >= MIN_DELTA)).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    weights = {r["feature"]: float(r["delta"]) for r in kept}
    nt, nc = total[0]
    share = min(0.5, sum(r["t"] for r in kept if r["kind"] == 0) / nt)
    chance = min(0.4, (sum(r["c"] for r in kept if r["kind"] == 0) + 0.5) / nc)
    background = min(-0.05, math.log((1 - share) / (1 - chance)))
    m = Model(weights, background, _lambda([(r["c"] / nc, float(r["delta"])) for r in kept if r["kind"] == 0], background))
    return _calibrated(m, train)


def _lambda(scores: list[tuple[float, float]], background: float) -> float:
    """The positive root x of the mean of exp(x score) = 1 over the tokens of clean texts: (share, score) pairs, and the background."""
    p, s = np.array([x[0] for x in scores] or [0.0]) + 1e-9, np.array([x[1] for x in scores] or [1.0])
    rest = max(1e-6, 1 - p.sum())
    f = lambda x: float(np.sum(p * np.exp(x * s))) + rest * math.exp(x * background) - 1
    lo, hi = 0.0, 0.125
    while f(hi) < 0 and hi < 8:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(4.0, max(0.1, hi))


def statistic(model: Model):
    """A column function text -> (statistic, number of significant passages, their tokens)."""

    @F.pandas_udf("stat double, n_passages int, toxic_tokens long, spans array<int>")
    def stat(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = _Scores(model)
        for s in texts:
            rows = [passages(t or "", model, scores) for t in s]
            yield pd.DataFrame({"stat": [r[0] for r in rows], "n_passages": [len(r[1]) for r in rows], "toxic_tokens": [sum(b - a for a, b, _ in r[1]) for r in rows], "spans": [[x for a, b, _ in r[1] for x in (a, b)] for r in rows]})

    return stat.asNondeterministic()  # so that a filter on its result does not carry it into what makes the text


def _calibrated(model: Model, train: DataFrame) -> Model:
    """Fits the logistic curve by Newton's method on counts of training rows in bins of the statistic, which are bounded in number."""
    at = F.greatest(F.lit(-30.0), F.least(F.lit(100.0), F.col("s.stat")))
    rows = train.select("toxic", statistic(model)("text").alias("s")).groupBy((F.round(at * 4) / 4).alias("x"), "toxic").count().collect()
    x, y, n = (np.array([float(r[k]) for r in rows]) for k in ("x", "toxic", "count"))
    if not len(x):
        return model
    a, b = 0.0, 0.0
    prior = 1e-2  # keeps the curve finite where the classes are apart
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        g = np.array([np.sum(n * (y - p)), np.sum(n * (y - p) * x) - prior * b])
        w = n * p * (1 - p)
        h = np.array([[np.sum(w) + 1e-6, np.sum(w * x)], [np.sum(w * x), np.sum(w * x * x) + prior]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    if b <= 0:
        return model
    return Model(model.weights, model.background, model.lam, float(a), float(b))


def score(docs: DataFrame, model: Model, out: str = "_tox") -> DataFrame:
    """docs with a struct column `out`: score (0 to 1), n_passages, toxic_tokens, spans (first and end token of each significant
    passage). A null or empty text scores as one without passages."""
    s = docs.withColumn(out, statistic(model)(F.col("text")))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), model.a + model.b * F.col(f"{out}.stat")))))
    return s.withColumn(out, F.struct(p.alias("score"), *(F.col(f"{out}.{c}").alias(c) for c in ("n_passages", "toxic_tokens", "spans"))))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train: DataFrame | None = None) -> DataFrame:
    """The rows of docs that score below the threshold, columns unchanged. The model learns from rows of train (docs where not
    given) that labels name."""
    tox = spare(docs, "tox")
    return score(docs, fit(docs if train is None else train, labels), tox).where(F.col(tox)["score"] < threshold).drop(tox)


def op6_toxic_segments(spark, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; see the module."""
    docs = typed(table(spark, sf_dir, "documents"), "doc_id long, text string")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = crc_mod("doc_id", 3) == 1
    return out.select("doc_id", held.alias("held_out"), F.col("_tox.score").alias("score"), (F.col("_tox.score") >= 0.7).cast("int").alias("predicted"), F.col("_tox.n_passages").alias("n_passages"), F.col("_tox.toxic_tokens").alias("toxic_tokens"), F.col("_tox.spans").alias("spans"))
