"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some positions of a short window and ignore the others, so that a window with substituted words still gives an
equal hash. Every window of the test items gives a seed; windows of the training texts are hashed alike, a bit set of bounded size over the
seeds lets few of them through, and these are joined with the seeds on mask and hash. A hit fixes a diagonal (text place minus item
place) on which the overlap is then verified around the hits: a stretch of WINDOW tokens, or the whole of a shorter item, with at least
SHARE of its tokens equal. Any such stretch contains a hit of one of the masks for its item's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, checked_join, checkpoint, spare, table, typed

WINDOW, SHARE = 12, 0.8
#: Masks for windows of items of WINDOW tokens and more (fixed values).
MASKS = ("11111", "110111", "1011101")
#: Those for shorter items, with the least and largest length: of 10 and 11 tokens two may differ, of 5 to 9 one, of 3 and 4 none; items of
#: one or two tokens overlap nothing.
SHORT = (("111", 3, 3), ("1111", 4, 4), ("11", 5, 5), ("111", 6, 11))
EVERY = (*((m, WINDOW, None) for m in MASKS), *SHORT)
#: Bits of the filter over the seeds, at most.
MAX_BITS = 1 << 26
#: Tokens that a worker hashes at once (one text at least).
BATCH_TOKENS = 300_000
TOKEN = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def tokens(text: str | None, hashes: dict) -> np.ndarray:
    """Hashes of the \\w+ of the lower-cased text."""
    w = TOKEN.findall((text or "").lower())
    return np.fromiter(map(hashes.__getitem__, w), dtype=np.uint64, count=len(w))


def windows(t: np.ndarray, k: int) -> np.ndarray:
    """The hash of each window of the tokens under mask k."""
    at = offsets(EVERY[k][0])
    n = max(0, len(t) - at[-1])
    h = np.full(n, k + 1, dtype=np.uint64)
    for o in at:
        h = (h ^ t[o : o + n]) * MIX
        h ^= h >> np.uint64(29)
    return h


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, h, at): the windows of each item under the masks for its length."""
    hashes = _Hashes()
    for b in batches:
        rows = [(i, h, at) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h, at in seeds(tokens(text, hashes))]
        items, h, at = (list(x) for x in zip(*((i, h, at) for i, hs, ats in rows for h, at in zip(hs, ats)))) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.int32())], names=["item", "h", "at"])


def seeds(t: np.ndarray) -> Iterator[tuple[list[int], list[int]]]:
    for k, (_, least, most) in enumerate(EVERY):
        if least <= len(t) <= (most or len(t)):
            h = windows(t, k).view(np.int64)
            yield h.tolist(), list(range(len(h)))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for b in batches:
        body = [tokens(x, hashes).view(np.int64) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(body, pa.list_(pa.int64()))], names=["item", "item_id", "body"])


def _bits(seeds: DataFrame, n: int) -> np.ndarray:
    """A bit set over the seeds' hashes, two bits each: of a power of 2, MAX_BITS at most."""
    size = 1 << 12
    while size < min(MAX_BITS, 64 * n):
        size *= 2
    seeds = seeds.select(F.explode(F.array("h", F.shiftrightunsigned("h", 32))).alias("h"))
    h = F.col("h").bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))
    out = np.zeros(size // 64, "<i8")
    for r in seeds.groupBy(F.floor(h / 64).alias("i")).agg(F.bit_or(bit).alias("v")).toLocalIterator():  # size / 64 rows at most
        out[r["i"]] = r["v"]
    return out.view("<u8")


def _probe(bits: Broadcast, least: int):
    """For each stretch of a text around windows that the bit set lets through: row, doc_id, first (its place), t (its tokens), and the
    windows, hs and ats (their hashes and places in the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = bits.value, _Hashes()
        mask = np.uint64(len(table) * 64 - 1)

        def found(rows: list, texts: list[np.ndarray]) -> pa.RecordBatch:
            t, ends = np.concatenate(texts), np.cumsum([*map(len, texts)])
            hs, ats, spans = [], [], []
            for k, (m, _, _) in enumerate(EVERY):
                h = windows(t, k)
                at = np.arange(len(h))
                for shift in (0, 32):
                    x = (h[at] >> np.uint64(shift)) & mask
                    at = at[np.flatnonzero((table[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1))]
                own = np.searchsorted(ends, at, "right")
                ok = at + len(m) <= ends[own] if len(at) else np.zeros(0, bool)  # not across two texts
                hs.append(h[at[ok]]), ats.append(at[ok]), spans.append(np.full(ok.sum(), len(m)))
            h, at, span = np.concatenate(hs), np.concatenate(ats), np.concatenate(spans)
            order = np.argsort(at, kind="stable")
            h, at, span = h[order], at[order], span[order]
            own = np.searchsorted(ends, at, "right")
            starts = np.concatenate([[0], ends])[own]
            lo, hi = np.maximum(starts, at - WINDOW + 1), np.minimum(ends[own], at + span + WINDOW - 1)
            new = np.ones(len(at), dtype=bool)
            new[1:] = (own[1:] != own[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1])
            cuts = np.flatnonzero(new)
            last = np.append(cuts[1:], len(at))
            out: list[list] = [[], [], [], [], [], []]
            for a, b in zip(cuts.tolist(), last.tolist()):
                row, s = rows[own[a]], starts[a]
                for col, v in zip(out, (*row, lo[a] - s, t[lo[a] : hi[a:b].max()].view(np.int64), h[a:b].view(np.int64), (at[a:b] - s).astype(np.int32))):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["row", "doc_id", "first", "t", "hs", "ats"])

        rows, texts, n = [], [], 0
        for b in batches:
            for row, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                t = tokens(text, hashes)
                if len(t) >= least:
                    rows.append((row, doc_id))
                    texts.append(t)
                    n += len(t)
                if n > BATCH_TOKENS:
                    yield found(rows, texts)
                    rows, texts, n = [], [], 0
        if texts:
            yield found(rows, texts)

    return run


def overlap(t: np.ndarray, first: int, body: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first token in the text, tokens compared, tokens equal) of a stretch of a text that begins at first with an item's tokens on a
    diagonal; None where no window has enough equal ones."""
    a, b = max(0, first - diagonal), min(len(body), first + len(t) - diagonal)
    w = min(WINDOW, len(body))
    if b - a < w:
        return None
    same = np.concatenate([[0], np.cumsum(body[a:b] == t[a + diagonal - first : b + diagonal - first])])
    if (same[w:] - same[:-w]).max() < SHARE * w - 1e-9:
        return None
    return a + diagonal, b - a, int(same[-1])


class Index:
    """Test items in memory, for single texts: the same search."""

    def __init__(self, items: list[tuple[int, str]]):
        self.hashes, self.seeds = _Hashes(), {}
        self.items = [(i, tokens(t, self.hashes)) for i, t in items]
        for k, (_, body) in enumerate(self.items):
            for hs, ats in seeds(body):
                for h, at in zip(hs, ats):
                    self.seeds.setdefault(h, []).append((k, at))

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, first token in the text, tokens compared, tokens equal) of each item's best verified overlap."""
        t, best = tokens(text, self.hashes), {}
        found = {(k, p - at) for m in range(len(EVERY)) for p, h in enumerate(windows(t, m).view(np.int64).tolist()) for k, at in self.seeds.get(h, ())}
        for k, diagonal in sorted(found):
            got = overlap(t, 0, self.items[k][1], diagonal)
            if got and (k not in best or got[2] > best[k][3]):
                best[k] = (self.items[k][0], *got)
        return list(best.values())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, doc_ids, items, firsts, diagonals = (b.column(i).to_pylist() for i in range(5))
        t, body = b.column(5), b.column(6)
        out = []
        for i in range(b.num_rows):
            got = overlap(t[i].values.to_numpy(), firsts[i], body[i].values.to_numpy(), diagonals[i])
            if got:
                out.append((rows[i], doc_ids[i], items[i], *got))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 3)], names=["row", "doc_id", "item_id", "first_token", "n_compared", "n_equal"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and test item with a verified overlap: doc_id, item_id, first_token, n_compared, n_equal (tokens compared
    and equal from there on, in the stretch around the hits; of several such stretches that with the most equal ones).

    Tokens are \\w+ of the lower-cased text. Null and empty texts and items overlap nothing; items of one or two tokens neither;
    items of three and four tokens only in full. Repeated rows of documents give repeated rows, repeated items one; an empty table gives
    none. Further columns do not count.
    """
    return _overlaps(typed(docs, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id()), benchmark).drop("row")


def _overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same for docs with a column row, and with it."""
    spark = docs.sparkSession
    items = typed(benchmark, "item_id long, text string").where("text is not null").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    with Scratch(spark) as tmp:
        seed = tmp.save(items.select("item", "text").mapInArrow(_seeds, "item long, h long, at int"))
        body = tmp.save(items.select("item", "item_id", "text").mapInArrow(_bodies, "item long, item_id long, body array<long>"))
        bits = spark.sparkContext.broadcast(_bits(seed, seed.count()))
        least = body.agg(F.coalesce(F.min(F.when(F.size("body") > 2, F.size("body"))), F.lit(3))).first()[0]
        found = docs.select("row", "doc_id", "text").mapInArrow(_probe(bits, min(least, WINDOW)), "row long, doc_id long, first int, t array<long>, hs array<long>, ats array<int>")
        found = tmp.save(found)
        hits = found.select("row", "first", F.explode(F.arrays_zip("hs", "ats")).alias("x")).select("row", "first", F.col("x.hs").alias("h"), F.col("x.ats").alias("p"))
        by_hash = seed.groupBy("h").agg(F.collect_set(F.struct("item", "at")).alias("s"))
        hits = checked_join(hits, by_hash, ["h"], "inner").select("row", "first", "p", F.explode("s").alias("s"))
        diagonals = hits.select("row", "first", F.col("s.item").alias("item"), (F.col("p") - F.col("s.at")).alias("diagonal")).distinct()
        pairs = tmp.save(diagonals).join(found.select("row", "doc_id", "first", "t"), ["row", "first"])
        pairs = checked_join(pairs, body, ["item"], "inner").select("row", "doc_id", "item_id", "first", "diagonal", "t", "body")
        good = pairs.mapInArrow(_verify, "row long, doc_id long, item_id long, first_token int, n_compared int, n_equal int")
        best = good.groupBy("row", "doc_id", "item_id").agg(F.max(F.struct("n_equal", (-F.col("first_token")).alias("f"), "n_compared")).alias("x"))
        out = checkpoint(best.select("row", "doc_id", "item_id", (-F.col("x.f")).alias("first_token"), "x.n_compared", "x.n_equal"))
        bits.unpersist()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a verified overlap, columns unchanged, whatever their names. Null and empty texts stay; rows of the same
    id and text go together."""
    row = F.xxhash64("doc_id", "text")
    gone = _overlaps(typed(docs, "doc_id long, text string").withColumn("row", row), benchmark).select("row").distinct()
    mine, n = spare(docs, "row"), gone.count()
    x, gone = docs.withColumn(mine, row), gone.withColumnRenamed("row", mine)
    return x.join(F.broadcast(gone) if n <= 200_000 else gone, mine, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op3_spaced_seed_overlaps(spark, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
