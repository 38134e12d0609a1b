"""Perplexity under an interpolated modified Kneser-Ney model of any order, counted in Spark.

Each level of n-grams is counted from the texts by rounds over a hash of their contexts (single words from pairs), so that only a share of the n-grams is in the
shuffle at once: tasks hand on the n-grams of their texts as records of hashes, and a task for each bucket adds them up (at the order
itself), or counts the distinct words before them (at lower levels), and writes n-grams with their counts and contexts with their totals
as sorted arrays into the shared folder. Contexts of common words are dealt over several buckets, whose parts Spark adds up. Scoring
workers map these files into memory and look up a batch's distinct keys in order. The model lies in as many files as the corpus needs;
nothing of it but sums and the words of over ROWS_PER_BUCKET occurrences goes through the driver.

Where the texts to be scored are known, n-grams and contexts met once are kept only if a text that is not learned from has them; in the
texts learned from, what is not kept was met once.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, crc_mod, local_path, map_file, put_file, release, shared_dir, table, typed
from tessera.llm.wordhash import M2, Words, mix, pieces, unmix

#: Words are 48 bit hashes: of a billion words some two thousand pairs would agree.
BITS = (1 << 48) - 1
END, START = 1, 2  # hashes of the end token and of the context before a text
#: Words of an n-gram, the predicted one included.
ORDER = 3
#: Tokens to a bucket, on average, and rows of a file of words. Contexts of more tokens than that may lie in several buckets.
ROWS_PER_BUCKET = 500_000
#: Rounds in which the n-grams of a level are counted.
ROUNDS = 4
#: An n-gram on its way to its bucket: hashes of its context and of itself, and its count or, below the order, the hash of the n-gram with
#: the word before it; 0 for one that is only asked for.
RECORD = np.dtype([("context", "<u8"), ("gram", "<u8"), ("x", "<u8")])


def key_of(words: list[np.ndarray]) -> np.ndarray:
    """The key of n-grams given by their words, oldest first; of one word the word itself."""
    return functools.reduce(lambda k, w: mix(k * M2 + w), words)


def _known(h: np.ndarray) -> np.ndarray:
    h = h & np.uint64(BITS)
    return np.where(h > START, h, h + np.uint64(3))


class _Hashes(dict):
    """The hashes of single words, as _texts has them."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = int(_known(Words(np.frombuffer(word + b"\n", dtype=np.uint8), np.array([len(word)])).hash)[0])
        return h


def tokens(text: bytes | None, hashes: dict) -> np.ndarray:
    """Hashes of the words and of the end token. On UTF-8 bytes, lower() changes A-Z only and split() cuts at space and 9-13 only."""
    return np.array([*map(hashes.__getitem__, (text or b"").lower().split()), END], dtype=np.uint64)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, the tokens of their texts, and where each text begins; a bounded number of tokens at a time."""
    for b, words in pieces(batches, column, lower=True):
        count = words.counts()
        out = np.full(len(words.hash) + len(count), END, dtype=np.uint64)
        out[np.arange(len(words.hash)) + np.repeat(np.arange(len(count)), count)] = _known(words.hash)
        yield b, out, np.cumsum(count + 1) - (count + 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, t, starts in _texts(batches, 0):
        w, c = np.unique(t[~_flags(b, t, starts)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])


def _flags(b: pa.RecordBatch, t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The last column, for each token of its row."""
    return np.repeat(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), np.diff(starts, append=len(t)))


def grams(t: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the words of its n-gram, oldest first; START stands for those before a text."""
    cols = [t]
    for _ in range(order - 1):
        before = np.empty_like(cols[0])
        before[1:] = cols[0][:-1]
        before[starts] = START
        cols.insert(0, before)
    return cols


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are neighbours, and where the groups begin in it."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else order


class Places:
    """Buckets of n-grams. Those of one context share a bucket, below `buckets`, unless all words of the context are common: then they lie
    in the upper half, in one of so many buckets as the context may fill. A bucket belongs to one round, that of the context's last word."""

    def __init__(self, buckets: int, common: dict[int, int]):
        self.rounds = min(buckets, ROUNDS)
        self.buckets = -(-buckets // self.rounds) * self.rounds
        self.words = np.array(sorted(common), dtype=np.uint64)
        self.parts = np.array([common[int(w)] for w in self.words], dtype=np.uint64)

    def shares(self, context: list[np.ndarray]) -> np.ndarray:
        """The number of buckets of each context, given by its words."""
        out = np.ones(len(context[0]), dtype=np.uint64)
        if len(self.words):
            found = []
            for w in context:
                at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
                found.append(np.where(self.words[at] == w, self.parts[at], np.uint64(1)))
            out = functools.reduce(np.minimum, found)
        return out

    def round(self, last: np.ndarray) -> np.ndarray:
        return last % np.uint64(self.rounds)

    def bucket(self, last: np.ndarray, shares: np.ndarray, context: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """last: the last word of the context."""
        salt = mix(gram) % shares if len(self.words) else np.uint64(0)
        at = mix(context + salt) % np.uint64(self.buckets // self.rounds) * np.uint64(self.rounds) + self.round(last)
        return (at + np.where(shares > 1, np.uint64(self.buckets), np.uint64(0))).astype(np.int32)


def _deal(order: int, k: int, places: Places, now: int):
    """The n-grams of k words of the round, as blocks of records by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t, starts in _texts(batches, 0):
            asked, cols = _flags(b, t, starts), grams(t, starts, min(order, k + 1))
            last = cols[-2] if k > 1 else cols[-1]  # a single word has no context, and is dealt as its own
            mine = np.flatnonzero(places.round(last) == now)
            asked, cols = asked[mine], [c[mine] for c in cols]
            words = cols[-k:-1] or cols[-1:]
            context, gram = key_of(words), key_of(cols[-k:])
            more = key_of(cols) if k < order else gram
            at = places.bucket(words[-1], places.shares(words), context, gram)
            i = np.flatnonzero(~asked)
            by, starting = _groups(more[i])
            some = i[by[starting]]
            x = more[some] if k < order else np.diff(starting, append=len(i)).astype(np.uint64)
            if k > 1:
                j = np.flatnonzero(asked)
                by, starting = _groups(gram[j])
                some, x = np.concatenate([some, j[by[starting]]]), np.concatenate([x, np.zeros(len(starting), dtype=np.uint64)])
            o, buckets, cuts = _by_bucket(at[some])
            rec = np.empty(len(some), dtype=RECORD)
            rec["context"], rec["gram"], rec["x"] = context[some[o]], gram[some[o]], x[o]
            data = pa.Array.from_buffers(pa.binary(), len(buckets), [None, pa.py_buffer((cuts * RECORD.itemsize).astype(np.int32).tobytes()), pa.py_buffer(rec)])
            yield pa.RecordBatch.from_arrays([pa.array(buckets), data], names=["bucket", "data"])

    return run


def _by_bucket(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, the buckets, and where each begins in it, and the end."""
    order = np.argsort(at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at, kind="stable")  # few bits are sorted in linear time
    buckets, first = np.unique(at[order], return_index=True)
    return order, buckets.astype(np.int32), np.append(first, len(at))


def _records(t: pa.Table) -> np.ndarray:
    out = []
    for c in t["data"].chunks:
        _, offsets, data = c.buffers()
        cuts = np.frombuffer(offsets, dtype=np.int32)[c.offset : c.offset + len(c) + 1]
        out.append(np.frombuffer(data, dtype=np.uint8)[cuts[0] : cuts[-1]].view(RECORD))
    return np.concatenate(out)


def _add_up(order: int, k: int, half: int, lean: bool, folder: str):
    """Counts a bucket's n-grams and writes them. Gives one row without a key, the sums of the level; with keys, the totals of contexts
    that other buckets share. Of single words a row each, and nothing else; and below pairs of words, in g, how many of the bucket's pairs
    end in a word, from which the level of single words follows."""

    def run(t: pa.Table) -> pa.Table:
        bucket, rec = t["bucket"][0].as_py(), _records(t)
        if k < order:  # each n-gram and word before it counts once
            by, first = _groups(rec["x"])
            if len(by) and rec["x"][by[0]] == 0:  # of those asked for all stay
                first = np.concatenate([np.arange(np.count_nonzero(rec["x"] == 0)), first[1:]])
            rec = rec[by[first]]
        by, first = _groups(rec["gram"])
        asked = np.logical_or.reduceat(rec["x"][by] == 0, first)
        n = np.add.reduceat((rec["x"] if k == order else (rec["x"] != 0))[by].astype(np.int64), first)
        context, gram = rec["context"][by[first]], rec["gram"][by[first]]
        if k == 1:
            return _rows(gram, n)
        if k == 2:  # the last word, from the key of the pair
            by, first = _groups(unmix(gram[n > 0]) - context[n > 0] * M2)
            words = _rows((unmix(gram[n > 0]) - context[n > 0] * M2)[by[first]], ends=np.diff(first, append=len(by)))
        keep = (n > 1) | ((n == 1) & (asked if lean else True))
        put_arrays(f"{folder}/grams{k}-{bucket}", gram[keep], {"c": n[keep]})
        by, first = _groups(context)
        n, add = n[by], lambda x: np.add.reduceat(x.astype(np.int64), first)
        total, few = add(n), [add(n == i) for i in (1, 2)] + [add(n > 2)]
        keep = total > (lean & ~np.logical_or.reduceat(asked[by], first) if bucket < half else 0)
        x = dict(zip(CONTEXT, (v[keep] for v in (total, *few))))
        context = context[by[first]][keep]
        put_arrays(f"{folder}/contexts{k}-{bucket}", context if bucket < half else context[:0], {v: x[v] if bucket < half else x[v][:0] for v in CONTEXT})
        shared = _rows(context, *x.values()) if bucket >= half else _rows(context[:0], n[:0])
        sums = [n.sum(), *((n == i).sum() for i in (1, 2, 3, 4)), (n > 2).sum()]
        return pa.concat_tables([_rows(np.zeros(1, dtype=np.uint64), *sums, bucket=bucket), shared, *([words] if k == 2 else [])])

    return run


#: Rows that counting a bucket gives. bucket is null for keys.
ROWS = "bucket int, k long, a long, b long, c long, d long, e long, f long, g long"


def _rows(key: np.ndarray, *values, bucket: int | None = None, ends: np.ndarray | None = None) -> pa.Table:
    nothing = pa.nulls(len(key), pa.int64())
    cols = [pa.array(np.broadcast_to(v, len(key)).astype(np.int64)) for v in values]
    at = pa.nulls(len(key), pa.int32()) if bucket is None else pa.array([bucket] * len(key), pa.int32())
    return pa.table([at, pa.array(key.view(np.int64)), *cols, *[nothing] * (6 - len(cols)), nothing if ends is None else pa.array(ends)], names=["bucket", "k", *"abcdefg"])


def put_arrays(uri: str, keys: np.ndarray, values: dict[str, np.ndarray]) -> None:
    """Writes a file of the number of keys and the bytes of a value, the sorted keys and their records."""
    order = np.argsort(keys)
    wide = 8 if any(len(v) and v.max() >= 1 << 32 for v in values.values()) else 4
    rec = np.empty(len(keys), dtype=[(v, f"<u{wide}") for v in values])
    for v in values:
        rec[v] = values[v][order]
    put_file(uri, np.array([len(keys), wide], dtype=np.uint64).tobytes() + keys[order].tobytes() + rec.tobytes())


def _write(df: DataFrame, values: list[str], uri: str) -> int:
    """Writes the rows (h, values) as files uri-K by K, the key's bucket; gives the number of buckets."""
    buckets = max(1, -(-df.count() // ROWS_PER_BUCKET))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (mix(b.column(0).to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], names=["bucket", "h", *values])

    def write(t: pa.Table) -> pa.Table:
        k = t["bucket"][0].as_py()
        put_arrays(f"{uri}-{k}", t["h"].to_numpy().view(np.uint64), {v: t[v].to_numpy() for v in values})
        return pa.table({"bucket": pa.array([k], pa.int32())})

    kinds = ", ".join(f"{v} long" for v in values)
    done = df.select("h", *values).mapInArrow(keyed, f"bucket int, h long, {kinds}").groupBy("bucket").applyInArrow(write, "bucket int")
    found = {r["bucket"] for r in done.toLocalIterator()}  # a small row a file
    for k in set(range(buckets)) - found:  # empty ones too, so that a missing file is an error
        put_arrays(f"{uri}-{k}", np.zeros(0, dtype=np.uint64), {v: np.zeros(0, dtype=np.int64) for v in values})
    return buckets


WORD, GRAM, CONTEXT = ("c", "before"), ("c",), ("total", "n1", "n2", "n3")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; fixed ones where a corpus is too small to have them."""
    if min(n1, n2, n3) == 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(i + 0.95, max(0.05, x)) for i, x in enumerate(d))


class Model:
    """Sizes, discounts and the folder of the sorted arrays; small, so that it goes to the workers as it is."""

    def __init__(self, folder: str, order: int, buckets: dict[str, int], n: int, v: int, d: dict[int, tuple], before: tuple, places: Places | None = None, lean: bool = False):
        self.folder, self.order, self.buckets, self.n, self.v, self.lean = folder, order, buckets, n, v, lean
        self.places = places or Places(buckets["grams"], {})
        self.d = {k: np.array([0.0, *x]) for k, x in d.items()}
        self.before, (a, b, c) = before[0], before[1:]
        # the share of the unigram level that goes to the uniform one over all words and an unknown one
        self.rest = (self.d[1][1] * a + self.d[1][2] * b + self.d[1][3] * c) / max(1, self.before)

    def look_up(self, name: str, values: tuple, key: np.ndarray, bucket: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """The values of each key; zeros for unknown ones. bucket: where it lies, if that does not follow from the key."""
        out = {v: np.zeros(len(key), dtype=np.int64) for v in values}
        by, buckets, cuts = _by_bucket((mix(key) % np.uint64(self.buckets[name])).astype(np.int32) if bucket is None else bucket)
        h = key[by]
        for k, i, j in zip(buckets.tolist(), cuts, cuts[1:]):
            keys, records = _file(f"{self.folder}/{name}-{k}", values)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h[i:j]), len(keys) - 1)
                ok = np.flatnonzero(keys[at] == h[i:j])
                mine, found = by[i:j][ok], records[at[ok]]
                for v in values:
                    out[v][mine] = found[v]
        return out

    def score(self, docs: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text."""
        return list(zip(*(x.tolist() for x in self.scores(np.concatenate(docs), np.cumsum([0, *map(len, docs[:-1])])))))

    def scores(self, t: np.ndarray, starts: np.ndarray, learned: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base scores and scores of the texts that begin at starts. learned: the tokens of texts learned from,
        without which a lean model lacks n-grams."""
        cols = grams(t, starts, self.order)
        rec = self.look_up("words", WORD, cols[-1])
        base = np.log10((rec["c"] + 1) / (self.n + self.v + 1))
        p = np.maximum(rec["before"] - self.d[1][np.minimum(rec["before"], 3)], 0) / max(1, self.before) + (self.rest if self.before else 1.0) / (self.v + 1)
        for k in range(2, self.order + 1):
            context, gram, d = key_of(cols[-k:-1]), key_of(cols[-k:]), self.d[k]
            shares = self.places.shares(cols[-k:-1])
            at = self.places.bucket(cols[-2], shares, context, gram)
            n = self.look_up(f"grams{k}", GRAM, gram, at)["c"]
            x = self.look_up(f"contexts{k}", CONTEXT, context, at)  # those of shared buckets have none there
            if len(some := np.flatnonzero(shares > 1)):
                for v, found in self.look_up(f"shared{k}", CONTEXT, context[some]).items():
                    x[v][some] = found
            if self.lean:  # what is not there was met once
                n[learned & (n == 0)] = 1
                once = learned & (x["total"] == 0)
                x["total"][once] = x["n1"][once] = 1
            total = np.maximum(x["total"], 1)
            left = np.where(x["total"] > 0, (d[1] * x["n1"] + d[2] * x["n2"] + d[3] * x["n3"]) / total, 1.0)
            p = np.maximum(n - d[np.minimum(n, 3)], 0) / total + left * p
        add = lambda x: np.add.reduceat(x, starts)
        return np.diff(starts, append=len(t)), add((rec["c"] > 0).astype(np.int64)), add(base), add(np.log10(p))


@functools.lru_cache(maxsize=4096)
def _file(uri: str, values: tuple) -> tuple[np.ndarray, np.ndarray]:
    """A mapped file of the model: keys, and records of the values. A file that is not there is an error."""
    data = map_file(uri, np.uint8)
    n, wide = (int(x) for x in data[:16].view("<u8"))
    return data[16 : 16 + 8 * n].view("<u8"), data[16 + 8 * n :].view([(v, f"<u{wide}") for v in values])


def fit(train: DataFrame, order: int = ORDER, held: Column | None = None) -> Model:
    """Counts the model over all rows of train (a column text; null: empty). held: rows that are not learned from; the model then serves
    these texts and those learned from, and no others."""
    spark = train.sparkSession
    folder = f"{shared_dir(spark)}/kneserney-{uuid.uuid4().hex}"
    if p := local_path(folder):
        atexit.register(shutil.rmtree, p, ignore_errors=True)
    lean = held is not None
    train = train.select(F.col("text").cast("string"), (F.coalesce(held, F.lit(False)) if lean else F.lit(False)).alias("held")).select(_line(), "held")
    with Scratch(spark) as tmp:
        words = tmp.save(train.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
        release(spark)
        n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        # words of more than a bucket of tokens: n / ROWS_PER_BUCKET at most; the context before a text is as common as its end
        common = {r["h"]: -(-r["c"] // ROWS_PER_BUCKET) for r in words.where(F.col("c") > ROWS_PER_BUCKET).toLocalIterator()}
        if END in common:
            common[START] = common[END]
        places = Places(max(1, -(-n // ROWS_PER_BUCKET)), common)
        buckets, d = {"grams": places.buckets}, {}
        for k in range(order, 0, -1):
            parts = []
            for now in range(places.rounds if k > 1 or order == 1 else 0):
                dealt = train.mapInArrow(_deal(order, k, places, now), "bucket int, data binary")
                parts.append(tmp.save(dealt.groupBy("bucket").applyInArrow(_add_up(order, k, places.buckets, lean, folder), ROWS)))
                release(spark)
            rows = functools.reduce(DataFrame.union, parts) if parts else rows
            if k == 1:
                level = rows.where("bucket is null").select(F.col("k").alias("h"), F.col("a" if parts else "g").alias("n")).where("n is not null").groupBy("h").agg(F.sum("n").alias("before"))
                level = tmp.save(level)
                for x in parts or below:
                    tmp.drop(x)
                release(spark)
                s = level.agg(F.coalesce(F.sum("before"), F.lit(0)), *(F.count_if(F.col("before") == i) for i in (1, 2, 3, 4)), F.count_if(F.col("before") > 2)).first()
            else:
                own = rows.where("bucket is not null")
                s = own.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in "abcdef")).first()
                found = {r["bucket"] for r in own.select("bucket").toLocalIterator()}  # a small row a file
                for b in set(range(2 * places.buckets if common else places.buckets)) - found:  # empty ones too, so that a missing file is an error
                    for name, values in (("grams", GRAM), ("contexts", CONTEXT)):
                        put_arrays(f"{folder}/{name}{k}-{b}", np.zeros(0, dtype=np.uint64), {x: np.zeros(0, dtype=np.int64) for x in values})
                if common:
                    shared = rows.where("bucket is null and a is not null").groupBy(F.col("k").alias("h")).agg(*(F.sum(x).alias(y) for x, y in zip("abcd", CONTEXT)))
                    buckets[f"shared{k}"] = _write(tmp.save(shared), [*CONTEXT], f"{folder}/shared{k}")
            d[k], below = discounts(*s[1:5]), parts
        both = words.join(level, "h", "left").withColumn("before", F.coalesce("before", F.lit(0)))
        both = tmp.save(both)
        for x in (words, level):
            tmp.drop(x)
        release(spark)
        buckets["words"] = _write(both, [*WORD], f"{folder}/words")
    release(spark)
    return Model(folder, order, buckets, n, v, d, (s[0], s[1], s[2], s[5]), places, lean)


def score(docs: DataFrame, model: Model, held: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of docs (doc_id, text; a null text is empty: one end token). Repeated
    rows and equal texts score alike, null ids stay, further columns do not count, an empty table gives no rows, and a model of an empty
    table has the one unknown word. held: as in fit, for a model that was fitted with it, whose table docs is."""
    if model.lean != (held is not None):
        raise ValueError("give held to fit and score, or to neither")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t, starts in _texts(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, model.scores(t, starts, ~_flags(b, t, starts)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    flag = (F.lit(False) if held is None else F.coalesce(held, F.lit(False))).alias("held")
    have = typed(docs, "doc_id long, text string") if held is None else docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), flag)
    return have.select("doc_id", _line(), flag if held is None else "held").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def _line() -> Column:
    """The text as pieces() takes it; a null one is empty."""
    return F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("text")


def op9_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """The log10 probability of every document under a model of those whose crc32 of the id modulo 7 is not 2."""
    docs = typed(table(spark, sf_dir, "documents"), "doc_id long, text string")
    held = crc_mod("doc_id", 7) == 2
    model = fit(docs, held=held)
    return score(docs, model, held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
