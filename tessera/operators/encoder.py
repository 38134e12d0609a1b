"""A dense encoder learned from the corpus: a truncated singular value decomposition of hashed tf-idf vectors.

Terms are hashed to a fixed number of features, so that the model is a matrix of features by dimensions whatever the vocabulary.
Features and their counts are worked out of the texts once and written, for the time of the fit. Document frequencies and rounds are
of all items. The right singular vectors are found by block power iteration with a random start: each round is one pass over the written
counts in which every task multiplies its own rows by the current block and hands on sums by feature.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrow import slices
from tessera.functions.text import terms
from tessera.plans.lineage import delete, fresh_dir, release

FEATURES, DIMS, EXTRA = 1 << 15, 64, 8
ROUNDS, SEED = 4, 7
#: Tasks of a round for each core at most, as each hands on a sum for every feature, and features of a row in which it does.
PER_CORE, SLICE = 2, 2048

TERM = re.compile("[a-z0-9]+")
COUNTS = "hash long, at array<int>, n array<int>"


@dataclass(frozen=True)
class Encoder:
    """idf of each feature, and the directions: features by dimensions, orthonormal, with their singular values."""

    idf: np.ndarray
    directions: np.ndarray
    values: np.ndarray

    def encode(self, items: DataFrame, key: list[str], text: str = "text") -> DataFrame:
        """key, embedding: the item's unit vector; null where the text has no term that the model knows."""
        model = items.sparkSession.sparkContext.broadcast(self)
        rows = items.select(*key, F.col(text).alias("_text"))
        schema = T.StructType([*rows.schema.fields[:-1], T.StructField("embedding", T.ArrayType(T.FloatType()))])
        return rows.mapInArrow(_encoded(model), schema)


def _sparse(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and their weights, of unit length."""
    c: dict[int, int] = {}
    for t, n in Counter(TERM.findall((text or "").lower())).items():
        f = zlib.crc32(t.encode()) % len(idf)
        c[f] = c.get(f, 0) + n
    at = np.fromiter(c, np.int64, len(c))
    w = (1 + np.log(np.fromiter(c.values(), float, len(c)))) * idf[at]
    size = np.linalg.norm(w)
    return at, w / size if size > 0 else w


def _encoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        part = np.empty_like(m.directions)  # for the directions of a text's features
        for b in slices(batches):
            out = []
            for text in b.column(b.num_columns - 1).to_pylist():
                at, w = _sparse(text, m.idf)
                v = w @ np.take(m.directions, at, axis=0, out=part[: len(at)], mode="clip")
                size = np.linalg.norm(v)
                out.append((v / size).astype("f4") if size > 1e-9 else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names[:-1], "embedding"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, the features of a text's terms) to (hash, its features, the count of each)."""
    for b in slices(batches):
        of = b.column(1)
        row = np.repeat(np.arange(len(of)), of.value_lengths().to_numpy())
        pairs, n = np.unique(row << 32 | of.flatten().to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(pairs >> 32, np.arange(len(of) + 1)).astype("i4"))
        at = (pairs & 0xFFFFFFFF).astype("i4")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(n.astype("i4")))], names=["hash", "at", "n"])


def _weighted(b: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features of each row of counts and their weights, as _sparse has them of a text."""
    sizes = b.column("at").value_lengths().to_numpy()
    row, at = np.repeat(np.arange(len(sizes)), sizes), b.column("at").flatten().to_numpy()
    w = (1 + np.log(b.column("n").flatten().to_numpy())) * idf[at]
    w = (w / np.sqrt(np.bincount(row, w * w))[row]).astype("f4")
    ends = np.cumsum(sizes)[:-1]
    return zip(np.split(at, ends), np.split(w, ends))


def _products(idf, block):
    """Of the rows of a task, A, and the block Q: the slices of A'(A Q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        total = np.zeros(q.shape)
        part, sums = np.empty_like(q), np.empty_like(total)  # for a row's part of both, as new arrays of that size are slow to get
        for b in slices(batches):
            for i, x in _weighted(b, idf.value):
                p, z = part[: len(i)], sums[: len(i)]
                y = x @ np.take(q, i, axis=0, out=p, mode="clip")
                np.take(total, i, axis=0, out=z, mode="clip")
                z += np.multiply(x[:, None], y, out=p)
                total[i] = z  # a row's features differ
        some = np.flatnonzero(total.any(axis=1))  # few of all features, where a task has few rows
        cuts = [x for x in np.split(some, np.searchsorted(some, np.arange(SLICE, len(q), SLICE))) if len(x)]
        columns = [pa.array([int(x[0]) // SLICE for x in cuts], pa.int64()), pa.array([x.astype("i4").tobytes() for x in cuts], pa.binary()), pa.array([total[x].astype("f4").tobytes() for x in cuts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "at", "sums"])

    return run


def _added(width: int):
    """The sums of all tasks for one slice."""

    def run(rows: pa.Table) -> pa.Table:
        total = np.zeros((SLICE, width))
        for of, at, sums in zip(rows["slice"].to_pylist(), rows["at"].to_pylist(), rows["sums"].to_pylist()):
            total[np.frombuffer(at, "i4") - of * SLICE] += np.frombuffer(sums, "f4").reshape(-1, width)
        return pa.table({"slice": rows["slice"][:1], "sums": [total.tobytes()]})

    return run


def _round(rows: DataFrame, idf, q: np.ndarray) -> np.ndarray:
    """A'A q, added up slice by slice in Spark; as large as q, which the features bound."""
    spark = rows.sparkSession
    release(spark)  # what the round before handed on
    block = spark.sparkContext.broadcast(q.astype("f4"))
    z = np.zeros_like(q)
    parts = rows.mapInArrow(_products(idf, block), "slice long, at binary, sums binary")
    for of, sums in parts.groupBy("slice").applyInArrow(_added(q.shape[1]), "slice long, sums binary").collect():
        whole = np.frombuffer(sums, float).reshape(SLICE, -1)
        z[of * SLICE : (of + 1) * SLICE] = whole[: len(z) - of * SLICE]
    block.destroy()
    return z


def fit(items: DataFrame, key: list[str], dims: int = DIMS, features: int = FEATURES, sample: int | None = None, rounds: int = ROUNDS, seed: int = SEED) -> Encoder:
    """The encoder of items (key, text). Null texts are empty; where the corpus has fewer directions than dims, the rest count nothing.
    What the driver holds is features by dims numbers. sample: by default the decomposition is of all items; with a number, of about so
    many that a hash of the key picks."""
    spark, folder = items.sparkSession, fresh_dir(items.sparkSession, "features")
    feature = F.transform(terms(F.coalesce("text", F.lit(""))), lambda t: (F.crc32(t.cast("binary")) % features).cast("int"))
    try:
        items.select(F.xxhash64(*key).alias("hash"), feature.alias("f")).mapInArrow(_counted, COUNTS).write.parquet(folder)
        rows = spark.read.schema(COUNTS).parquet(folder)
        n = rows.count()
        idf = np.zeros(features)
        for f, c in rows.select(F.explode("at").alias("f")).groupBy("f").count().collect():  # at most one row a feature
            idf[f] = np.log((1 + n) / (1 + c)) + 1
        if sample is not None and n > sample:
            rows = rows.where(F.pmod("hash", F.lit(n)) < sample)
        return _decomposed(rows.select("at", "n").coalesce(PER_CORE * spark.sparkContext.defaultParallelism), idf, dims, rounds, seed)
    finally:
        delete(spark, folder)


def _decomposed(rows: DataFrame, idf: np.ndarray, dims: int, rounds: int, seed: int) -> Encoder:
    features, sent = len(idf), rows.sparkSession.sparkContext.broadcast(idf)
    width = min(dims + EXTRA, features)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)) * (idf > 0)[:, None])[0]
    for _ in range(rounds):
        q = np.linalg.qr(_round(rows, sent, q))[0]
    inner = q.T @ _round(rows, sent, q)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:dims]
    values = np.sqrt(np.maximum(values[order], 0))
    directions = q @ turn[:, order]
    return Encoder(idf, directions * (values > 1e-9), values)
