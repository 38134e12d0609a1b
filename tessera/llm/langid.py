"""Language identification by prediction by partial matching over bytes.

For each language a context tree of orders 0 to 3 is counted on a bounded sample of labelled rows and then frozen. A byte costs the
code length under the longest known context, with escape probabilities of method C (distinct successors against all) down to a
uniform byte. A text goes to the language with the shortest code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checked_join, crc_mod, table, typed

#: Labelled rows a language that training reads, in expectation: those whose hash of the id falls below the share of rows it needs.
SAMPLE_PER_LANG = 1500
ORDER = 3
LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 20


def grams(data: bytes) -> np.ndarray:
    """Each byte with the three before it (line feeds before the first), as 32 bit numbers."""
    b = np.frombuffer(b"\n\n\n" + data, dtype=np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def counted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(data), return_counts=True)


class Tree:
    """Frozen statistics of one language: for each order the sorted contexts with successors, counts and distinct successors."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in range(ORDER + 1):
            mask = np.uint32((1 << (8 * (k + 1))) - 1) if k < 3 else np.uint32(0xFFFFFFFF)
            key, inverse = np.unique(keys & mask, return_inverse=True)
            c = np.bincount(inverse, weights=counts, minlength=len(key))
            ctx, start, = np.unique(key >> np.uint32(8), return_index=True)
            total = np.add.reduceat(c, start) if len(c) else c
            distinct = np.diff(np.append(start, len(key)))
            self.levels.append((mask, key, c, ctx, total, distinct))

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of grams g."""
        out, open_ = np.zeros(len(g)), np.arange(len(g))
        for mask, key, c, ctx, total, distinct in reversed(self.levels):
            if not len(key) or not len(open_):
                continue
            k = g[open_] & mask
            at = np.minimum(np.searchsorted(ctx, k >> np.uint32(8)), len(ctx) - 1)
            known = ctx[at] == k >> np.uint32(8)
            pos = np.minimum(np.searchsorted(key, k), len(key) - 1)
            hit = known & (key[pos] == k)
            all_ = total[at] + distinct[at]
            out[open_[hit]] -= np.log2(c[pos[hit]] / all_[hit])
            esc = known & ~hit
            out[open_[esc]] -= np.log2(distinct[at[esc]] / all_[esc])
            open_ = open_[~hit]
        out[open_] += 8.0
        return out


class Model:
    """The trees of all languages, with the costs of all grams that training saw worked out before."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.trees = [Tree(*counts[x]) for x in self.langs]
        self.known = np.unique(np.concatenate([counts[x][0] for x in self.langs])) if self.langs else np.zeros(0, np.uint32)
        self.cost = np.stack([t.bits(self.known) for t in self.trees], axis=1) if self.langs else np.zeros((0, 0))

    def lengths(self, text: str) -> np.ndarray:
        """Code length in bits of the whole text under each language."""
        data, total = text.lower().encode("utf-8", "replace"), np.zeros(len(self.langs))
        for a in range(0, len(data), CHUNK):
            g, n = np.unique(grams(data[max(0, a - 3) : a + CHUNK])[min(a, 3) :], return_counts=True)
            at = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
            seen = self.known[at] == g
            total += n[seen] @ self.cost[at[seen]]
            if not seen.all():
                total += n[~seen] @ np.stack([t.bits(g[~seen]) for t in self.trees], axis=1)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        bits = self.lengths(text)
        p = np.exp(-(bits - bits.min()) * np.log(2))
        return self.langs[int(bits.argmin())], float(p.max() / p.sum())


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    texts: dict[str, list[bytes]] = {}
    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            texts.setdefault(lang, []).append((text or "").lower().encode("utf-8", "replace"))
    for lang, x in texts.items():
        key, n = counted(b"\n\n\n".join(x))
        yield pd.DataFrame({"lang": lang, "gram": key.astype(np.int64), "n": n.astype(np.int64)})


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learns from rows with a language whose crc32 of the id modulo 5 is not 0; languages without a text are not learned."""
    rows = typed(docs, "doc_id long, text string, lang string").where("lang is not null and text is not null").where(crc_mod("doc_id", 5) != 0)
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), per_lang / F.count("*")).alias("_share"))
    mine = checked_join(rows, share, ["lang"], "inner").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("_share") * 1_000_003)
    counts = mine.select("lang", "text").mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # distinct grams of the bounded sample
    return Model({k: (x["gram"].to_numpy().astype(np.uint32), x["n"].to_numpy()) for k, x in got.sort_values(["lang", "gram"]).groupby("lang")})


def identify(docs: DataFrame, model: Model, out: str = "_lang") -> DataFrame:
    """docs with a struct column `out`: lang_pred (`und` for null texts and texts without a letter) and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(out, run(F.col("text")))


def op8_ppm_language(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = identify(typed(docs, "doc_id long, text string"), fit(docs))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "_lang.lang_pred", "_lang.score")
