"""N-gram Jaccard join by MinHash banding.

Documents with equal word sequences collapse to one. Each distinct text gives MinHash values of its 5-word shingles, grouped into
bands whose number and rows follow from the wanted recall at the threshold; texts that share a band hash are candidates. Candidates
are joined into groups, and inside a group every pair is verified on the full shingle sets, without a row per pair: a member is
held as its difference from the group's first text, and differences are compared block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, WORD, checkpoint, fits, quoted, table, typed

N, THRESHOLD, RECALL = 5, 0.8, 0.999
MAX_HASHES = 128
#: Members of a candidate group that are compared at once, and small groups done in one task.
BLOCK, PER_TASK = 256, 512
WORDS = re.compile(WORD)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bands_for(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows a band as leave, within `most` hashes, the wanted recall for a pair at the threshold."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[str], hashes: dict, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, an empty one none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = max(1, len(h) - n + 1)
    x = np.full(k, min(n, len(h)), dtype=np.uint64)
    for i in range(min(n, len(h))):
        x = mix(x * M2 + h[i : i + k])
    return np.unique(x)


def _signatures(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        rng = np.random.default_rng(77)
        a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
        b = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)
        seed = rng.integers(1, 2**63, bands, dtype=np.uint64)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORDS.findall((text or "").lower())
                key = xxhash.xxh3_128_digest(" ".join(words))
                s, sig = shingles(words, hashes), None
                if len(s):
                    least = np.full(len(a), np.uint64(2**64 - 1))
                    for at in range(0, len(s), 4096):  # bounded memory for long texts
                        part = s[at : at + 4096]
                        x = part[None, :] * a[:, None]
                        x += b[:, None]
                        x ^= x >> np.uint64(32)
                        np.minimum(least, x.min(axis=1), out=least)
                    v, sig = least.reshape(bands, rows), seed.copy()
                    for r in range(rows):
                        sig = mix(sig * M1 + v[:, r])
                    sig = sig.view(np.int64)
                for col, v in zip(out, (doc_id, *np.frombuffer(key, "<i8").tolist(), len(s), sig)):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["doc_id", "k1", "k2", "n", "bands"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the least node connected with it: alternating large-star and small-star
    steps, each a few joins; rows never exceed edges and nodes."""
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if now == last:
            break
        last = now
    # every edge now goes from a node to its root
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for b in batches:
        sets = [shingles(WORDS.findall((t or "").lower()), hashes).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "set"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own, first = (b.column(i).to_pylist() for i in (2, 3))
        out: list[list] = [[], [], [], []]
        for x, y in zip(own, first):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            for col, v in zip(out, (np.setdiff1d(x, y, True).tobytes(), np.setdiff1d(y, x, True).tobytes(), len(x), len(y))):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.binary(), pa.int32(), pa.int32())))], names=["node", "comp", "added", "removed", "n", "n_first"])


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """Numbers of equal elements for every pair of lists, each list's elements distinct."""
    n = len(lists)
    g = np.zeros((n, n), dtype=np.float32)
    if not any(map(len, lists)):
        return g
    owner = np.repeat(np.arange(n), list(map(len, lists)))
    _, inverse, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    owner, inverse = owner[shared], inverse[shared]
    if not len(inverse):
        return g
    _, column = np.unique(inverse, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1, 8192):
        a, b = np.searchsorted(column, [first, first + 8192])
        x = np.zeros((n, min(8192, int(column[-1]) + 1 - first)), dtype=np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        g += x @ x.T
    return g


def verify(ids: np.ndarray, block: np.ndarray, added: list, removed: list, n: np.ndarray, n_first: int, threshold: float, cross: bool) -> list[tuple[int, int, int]]:
    """(id, links, least id linked through links here) for each member; with cross, only pairs of different blocks count."""
    add, rem = _common(added), _common(removed)
    a, r = np.array([len(x) for x in added], dtype=np.float64), np.array([len(x) for x in removed], dtype=np.float64)
    np.fill_diagonal(add, a), np.fill_diagonal(rem, r)
    both = n_first - r[:, None] - r[None, :] + rem + add
    link = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-6
    np.fill_diagonal(link, False)
    if cross:
        link &= block[:, None] != block[None, :]
    root = ids.copy()
    while True:  # least id over links, until nothing changes
        least = np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(root, least)
        if (new == root).all():
            break
        root = new
    return list(zip(ids.tolist(), link.sum(axis=1).tolist(), root.tolist()))


def _verified(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        d = {c: t[c].to_numpy(zero_copy_only=False) for c in ("node", "comp", "bi", "bj", "block", "n", "n_first", "added", "removed")}
        order = np.lexsort((d["node"], d["bj"], d["bi"], d["comp"]))
        d = {k: v[order] for k, v in d.items()}
        cuts = np.flatnonzero((np.diff(d["comp"]) != 0) | (np.diff(d["bi"]) != 0) | (np.diff(d["bj"]) != 0)) + 1
        rows = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
            if b - a > 1:
                added, removed = ([np.frombuffer(x, np.uint64) for x in d[c][a:b]] for c in ("added", "removed"))
                rows += verify(d["node"][a:b], d["block"][a:b], added, removed, d["n"][a:b].astype(np.float64), int(d["n_first"][a]), threshold, bool(d["bi"][a] != d["bj"][a]))
        return pa.table({"node": pa.array([x[0] for x in rows], pa.int64()), "links": pa.array([x[1] for x in rows], pa.int64()), "root": pa.array([x[2] for x in rows], pa.int64())})

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, class_id (the least id of its class), n_links (different texts with a
    Jaccard similarity of the threshold or more, each counted once), n_copies (other rows with the same words).

    Words are compared in lower case. Texts with the same words are one class; a text of under five words is one shingle. Null and
    empty texts are classes of their own. A doc_id names one text: rows that repeat it count as copies. Pairs below the recall's
    share of 1 may be missed at the threshold itself; no pair is left out for the size of its group.
    """
    bands, rows = bands_for(threshold, recall)
    sig = checkpoint(typed(docs, "doc_id long, text string").mapInArrow(_signatures(bands, rows), "doc_id long, k1 long, k2 long, n int, bands array<long>"))
    full = sig.where("n > 0 and doc_id is not null")
    reps = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "bands")).alias("r"), F.count("*").alias("copies"))
    reps = checkpoint(reps.select("k1", "k2", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands"), "copies"))
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    first = keyed.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = checkpoint(components(keyed.join(first, "key").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))))
    # shingle sets of candidates only
    want = groups.select(F.col("node").alias("doc_id"))
    text = typed(docs, "doc_id long, text string")
    text = text.join(F.broadcast(want) if fits(want, BROADCAST_ROWS) else want, "doc_id", "left_semi")
    sets = text.mapInArrow(_sets, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))
    sets = checkpoint(sets.join(groups.withColumnRenamed("root", "comp"), "node").select("node", "comp", "set"))
    heads = sets.where("node = comp").select("comp", F.col("set").alias("head"))
    diff = sets.join(heads, "comp").select("node", "comp", "set", "head").mapInArrow(_differences, "node long, comp long, added binary, removed binary, n int, n_first int")
    size = groups.groupBy("root").count().select(F.col("root").alias("comp"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    diff = checkpoint(diff.join(size, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = F.explode(F.transform(other, lambda o: F.struct(F.least(o, F.col("block")).alias("bi"), F.greatest(o, F.col("block")).alias("bj"))))
    tasks = max(1, -(-diff.count() // PER_TASK))
    work = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(tasks))).otherwise(F.xxhash64("comp", "p.bi", "p.bj"))
    paired = diff.withColumn("p", pair).withColumn("work", work).select("work", "node", "comp", "block", "added", "removed", "n", "n_first", "p.bi", "p.bj")
    found = checkpoint(paired.groupBy("work").applyInArrow(_verified(threshold), "node long, links long, root long"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    about = reps.select("k1", "k2", "rep", "copies").join(links, reps["rep"] == links["node"], "left").drop("node")
    about = about.join(classes, about["rep"] == classes["node"], "left").drop("node")
    out = sig.select("doc_id", "n", "k1", "k2").join(about, ["k1", "k2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("root", "rep")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1).cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose doc_id is the least of its class, columns unchanged; of rows that repeat an id all stay or none."""
    gone = join(docs, threshold).where("class_id <> doc_id").select("doc_id").distinct()
    gone = checkpoint(gone)
    return docs.join(F.broadcast(gone) if fits(gone, BROADCAST_ROWS) else gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class and number of links of every document."""
    return join(table(spark, sf_dir, "documents"))
