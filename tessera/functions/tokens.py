"""Token counters: how many tokens a text has, for one text and as a column. Settings name the one that all counts come from."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from typing import Protocol

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions import segment
from tessera.functions.arrow import slices
from tessera.functions.text import token_count

#: Entries that a rank file may have; it is sent to every executor.
MOST_RANKS = 1 << 20


class TokenCounter(Protocol):
    name: str

    def count(self, text: str) -> int: ...

    def column(self, text: Column) -> Column: ...


class RegexCounter:
    """The stand-in without a vocabulary: runs of letters and digits, and single other visible characters."""

    name = "regex-approx"

    def count(self, text: str) -> int:
        return segment.count(text)

    def column(self, text: Column) -> Column:
        return token_count(text)


class RankCounter:
    """Tokens of a byte-pair vocabulary that is given by ranks (a file of lines `base64 rank`) and a pattern that splits a text into
    words, whose bytes are then merged. Strings that the vocabulary would mark as special are ordinary text. A null text has no count
    as a column (null), an empty one 0."""

    def __init__(self, name: str, pattern: str, ranks: Broadcast):
        self.name, self._pattern, self._ranks, self._words = name, pattern, ranks, None

    @classmethod
    def read(cls, spark: SparkSession, path: str, pattern: str) -> RankCounter:
        """Reads the rank file with Spark, so that path may be remote. An error if it is no rank file, lacks a byte or is too large."""
        lines = spark.read.text(path).where("value <> ''").limit(MOST_RANKS + 1).collect()
        if len(lines) > MOST_RANKS:
            raise ValueError(f"{path} has over {MOST_RANKS} ranks")
        try:
            ranks = {base64.b64decode(a, validate=True): int(b) for a, b in (r[0].split() for r in lines)}
        except ValueError as e:
            raise ValueError(f"{path} is no rank file: {e}") from e
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path} lacks ranks of single bytes")
        return cls(path.rstrip("/").rpartition("/")[2], pattern, spark.sparkContext.broadcast(ranks))

    @classmethod
    def resolve(cls, spark: SparkSession, paths: list[str], pattern: str) -> RankCounter:
        """The counter of the first file that can be read; an error that says what is wrong with each if none can."""
        tried = []
        for path in paths:
            try:
                return cls.read(spark, path, pattern)
            except Exception as e:  # whatever is wrong with one file, the next may do
                tried.append(f"{path}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        raise ValueError("no usable rank file: " + "; ".join(tried))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_words": None}

    def count(self, text: str) -> int:
        if self._words is None:
            self._words = _Words(self._ranks.value)
        words = self._words
        return sum(words[m.group()] for m in regex.finditer(self._pattern, text))

    def column(self, text: Column) -> Column:
        @F.arrow_udf("int")
        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for s in slices(texts):
                yield pa.array([None if t is None else self.count(t) for t in s.to_pylist()], pa.int32())

        return run(text)


class _Words(dict):
    """Word -> number of tokens, worked out at its first use. Long words are not kept, and all are dropped when there are too many."""

    MOST, LONGEST = 300_000, 64

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> int:
        n = merged(word.encode("utf-8", "surrogatepass"), self.ranks)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = n
        return n


def merged(word: bytes, ranks: dict[bytes, int]) -> int:
    """The number of pieces that are left of a word's bytes when the neighbours of least rank, the first of such, are joined until no
    pair has a rank. A heap of pairs keeps long words near linear; entries of pairs that have changed are skipped."""
    n = len(word)
    if n < 2 or word in ranks:
        return min(n, 1)
    before, after = list(range(-1, n)), list(range(1, n + 1))  # where the piece that starts here has its neighbours
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapify(heap)
    left = n
    while heap:
        _, i, end = heappop(heap)
        middle = after[i]
        if middle in (0, n) or after[middle] != end:
            continue
        after[i], after[middle], left = end, 0, left - 1  # a piece that is gone has no neighbour: 0 is no end
        before[end] = i
        if end < n and (r := ranks.get(word[i : after[end]])) is not None:
            heappush(heap, (r, i, after[end]))
        if i > 0 and (r := ranks.get(word[before[i] : end])) is not None:
            heappush(heap, (r, before[i], end))
    return left
