"""Settings of the compression engine."""

from __future__ import annotations

from dataclasses import dataclass, replace

from tessera.functions.splitters import RuleSplitter, SentenceSplitter
from tessera.functions.tokens import RegexCounter, TokenCounter

#: A budget that no context exceeds; a null budget column means the same.
UNLIMITED = None


@dataclass(frozen=True)
class Settings:
    counter: TokenCounter = RegexCounter()
    splitter: SentenceSplitter = RuleSplitter()
    chunk_tokens: int = 400
    overlap: float = 0.15
    min_chunks: int = 200
    index_buckets: int = 64
    top_k: int = 20
    rrf_k: int = 60
    min_sentence_tokens: int = 4
    weight_cross: float = 0.0
    weight_bm25: float = 1.0
    mmr_lambda: float = 0.7
    duplicate_similarity: float = 0.85
    relevance_threshold: float = 0.2
    budget: int | None = 800
    strip: bool = False
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    legacy_overlap: bool = False
    legacy_strip: bool = False
    elide_only_if_dropped: bool = False
    filter_table_body: bool = False
    sweep: tuple = (200, 400, 800, 1600, UNLIMITED)

    def weights(self) -> tuple[float, float]:
        """The weights of cross-encoder and BM25, summing to one."""
        total = self.weight_cross + self.weight_bm25
        if total <= 0:
            raise ValueError("score weights must have a positive sum")
        return self.weight_cross / total, self.weight_bm25 / total

    def pool(self) -> int:
        """Rows that each ranker hands to fusion."""
        return max(50, 3 * self.top_k)

    def but(self, **changes) -> "Settings":
        return replace(self, **changes)
