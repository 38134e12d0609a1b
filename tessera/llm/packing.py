"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Items of one length are interchangeable, so the packing follows from the histogram of lengths alone, which has at most `capacity`
rows whatever the corpus. The driver packs that histogram, many equal items at a time, with a segment tree over remaining
capacities that finds the tightest open bin in logarithmic time; executors then look up each item's bin by its rank among the
items of its length.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import checkpoint, rank_in_group, typed

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: The string that the tokenizer's file marks as special, and its id (fixed values).
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..n: first_at_least(x) is the least present value >= x."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, r: int, present: bool) -> None:
        i = r + self.size
        self.any[i] = present
        i //= 2
        while i:
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]
            i //= 2

    def first_at_least(self, x: int) -> int | None:
        i = x + self.size
        if x >= self.size:
            return None
        if self.any[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: rows (length, first rank, end rank, first bin, offset). Items of `length`
    with ranks first..end-1 go to bins first bin, first bin + 1, ..., each at `offset`. The bins equal those of placing items one
    by one into the tightest open bin, equal bins being interchangeable."""
    tree, groups, rows, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        need, rank = histogram[length], 0

        def fill(first: int, count: int, left: int, each: int) -> None:
            """each items into every one of count bins that have `left` remaining."""
            nonlocal rank
            for j in range(each):
                rows.append((length, rank, rank + count, first, capacity - left + j * length))
                rank += count
            rest = left - each * length
            if rest:
                groups.setdefault(rest, []).append((first, count))
                tree.put(rest, True)

        while need:
            left = tree.first_at_least(length)
            if left is None:
                left = capacity  # as many new bins as these items fill
                first, count = bins, -(-need // (capacity // length))
                bins += count
            else:
                first, count = groups[left].pop()
                if not groups[left]:
                    tree.put(left, False)
            each = left // length
            full = min(count, need // each)
            part = need - full * each if full < count else 0
            rest = count - full - bool(part)
            if rest:
                groups.setdefault(left, []).append((first + full + bool(part), rest))
                tree.put(left, True)
            if full:
                fill(first, full, left, each)
            if part:
                fill(first + full, 1, left, part)
            need -= full * each + part
    return rows


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "")
                ids.append(end_id)
                n = len(ids)
                raw = np.asarray(ids, dtype="<u4")
                cuts = [0, *range(n - capacity * ((n - 1) // capacity), n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for col, v in zip(out, (doc_id, k, a, b - a, zlib.crc32(raw[a:b].tobytes()), raw[a:b].astype("i4") if with_ids else None)):
                        col.append(v)
                if len(out[0]) >= 20_000:
                    yield _batch(out, with_ids)
                    out = [[] for _ in range(6)]
            yield _batch(out, with_ids)

    return run


def _batch(out: list[list], with_ids: bool) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds.values())], names=list(kinds))


@functools.cache  # one a worker process, not one a task
def encoder(path: str):
    """text -> list of ids, the same as tokenizers' encode(text, add_special_tokens=False). The rank file beside `path` holds the same
    vocabulary and is some four times faster; a text that its pattern matcher gives up on goes to the tokenizers library."""
    import base64
    import os

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    whole = None

    def slow(text: str) -> list[int]:
        nonlocal whole
        if whole is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
        return whole.encode(text, add_special_tokens=False).ids

    if not os.path.exists(ranks_path):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(text: str) -> list[int]:
        try:
            if "<|" in text:
                return fast.encode(text, allowed_special="all")
            return fast.encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
            return slow(text)

    return encode


def _place(rows: list[tuple[int, int, int, int, int]], capacity: int):
    key = np.array([(r[0] << 44) + r[1] for r in rows], dtype=np.int64)
    order = np.argsort(key)
    key, table = key[order], np.array(rows, dtype=np.int64).reshape(-1, 5)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            length, rank = t["length"].to_numpy(), t["_rank"].to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            hit = table[at]
            t = t.drop_columns(["_rank"]).append_column("sequence_id", pa.array(hit[:, 3] + rank - hit[:, 1], pa.int64())).append_column("offset", pa.array(hit[:, 4], pa.int64()))
            yield from t.to_batches()

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most `capacity` tokens, as few as best-fit decreasing finds.

    A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where with_ids. A document is its ids and
    then end_id; only a document over the capacity is cut, into pieces of the capacity of which the first may be shorter. Full pieces
    fill a sequence each. A null text is an empty one (one end token); repeated rows are packed as often as they come; an empty
    table gives no rows; other columns are ignored.
    """
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = checkpoint(typed(docs, "doc_id long, text string").mapInArrow(_pieces(path, capacity, end_id, with_ids), schema))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity)
    ranked = rank_in_group(pieces, "length", ["doc_id", "piece", "ids_crc32"], ["doc_id", "piece", "ids_crc32"], "_rank")
    names = [*pieces.columns, "_rank"]
    return ranked.select(*names).mapInArrow(_place(rows, capacity), schema + ", sequence_id long, offset long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens of byte_bpe_50k."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
