"""An inverted-file index of unit vectors: lists around centroids, searched by many queries at once.

Centroids are fitted by spherical k-means on a bounded sample; every vector is then put into the list of its nearest centroid, and a
list of many vectors is cut into parts, so that no task holds more than PART of them. A search looks into the lists nearest to a query
and, where it is to be exact, into every further list whose bound says that it may hold something better.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import BLOCK, ranked
from tessera.plans.lineage import bounded, cut

#: Vectors that centroids are fitted on, rounds of fitting, and lists at most.
SAMPLE, ROUNDS, MOST_LISTS = 50_000, 8, 4096
#: Vectors, and queries, of a group at most, give or take the unevenness of a hash.
PART, ASKED = 50_000, 20_000
#: Lists that a query looks into first.
PROBES = 8

VECTORS = "vec_id long, embedding array<double>, part int, list int"
CENTROIDS = "list int, centroid array<double>, n long, least_cos double, parts int"


def _unit(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(c), -1) if len(c) else flat.reshape(0, 1)


def _nearest(centroids: np.ndarray):
    """(vec_id, embedding) batches with the nearest list and the cosine to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sim = _matrix(b.column(1)) @ centroids.T
                best = sim.argmax(axis=1)
                yield b.append_column("list", pa.array(best.astype("i4"))).append_column("cos", pa.array(sim[np.arange(len(best)), best]))

    return run


def _sums(centroids: np.ndarray):
    """The sums of the vectors nearest to each centroid, over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centroids)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                np.add.at(total, (x @ centroids.T).argmax(axis=1), x)
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["list", "total"])

    return run


def fit(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids, `lists` of them at most, by spherical k-means on about `sample` vectors, chosen by a hash of their ids. The
    driver sees centroids and their sums only."""
    x = _unit(vectors)
    n = x.count()
    if n > sample:
        x = x.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < sample)
    x = cut(x)
    start = x.dropDuplicates(["embedding"]).orderBy(F.xxhash64("vec_id", F.lit(1))).limit(lists).collect()
    if not start:
        return np.zeros((0, 1))
    centroids = np.array([r["embedding"] for r in start])
    dims = centroids.shape[1]
    for _ in range(rounds):
        parts = x.mapInArrow(_sums(centroids), "list int, total array<double>")
        sums = parts.groupBy("list").agg(F.array(*(F.sum(F.col("total")[i]) for i in range(dims))).alias("total")).collect()
        moved = centroids.copy()
        for r in sums:
            v = np.array(r["total"])
            if (size := np.linalg.norm(v)) > 0:
                moved[r["list"]] = v / size
        if np.abs(moved - centroids).max() < 1e-6:
            break
        centroids = moved
    return centroids


def build(vectors: DataFrame, folder: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Writes every vector (vec_id, embedding: unit vectors of one length) into the list of its nearest centroid, and what bounds each
    list. Null vectors are left out; equal vectors, however many, are spread over parts. lists: by default the root of their number."""
    spark = vectors.sparkSession
    x = _unit(vectors)
    centroids = fit(x, lists or max(1, min(MOST_LISTS, round(x.count() ** 0.5))), sample)
    placed = cut(x.mapInArrow(_nearest(centroids), "vec_id long, embedding array<double>, list int, cos double"))
    sizes = {r["list"]: (r["n"], r["least"]) for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.min("cos").alias("least")).collect()}
    rows = [(i, c.tolist(), *sizes[i], -(-sizes[i][0] // PART)) for i, c in enumerate(centroids) if i in sizes]
    about = spark.createDataFrame(rows, CENTROIDS)
    about.write.mode("overwrite").parquet(f"{folder}/centroids")
    cell = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    out = placed.join(F.broadcast(about.select("list", "parts")), "list").select("vec_id", "embedding", cell.alias("part"), "list")  # at most MOST_LISTS
    out.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/vectors")
    return VectorIndex(spark, folder)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str

    def centroids(self) -> DataFrame:
        return self.spark.read.schema(CENTROIDS).parquet(f"{self.folder}/centroids")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(VECTORS).parquet(f"{self.folder}/vectors")

    def topk(self, queries: DataFrame, most: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """query_id, vec_id, similarity, dense_rank: the largest dot products of unit vectors, ties by vec_id. queries: query_id, qvec.

        A query looks into the `probes` lists of the nearest centroids. With exact it then looks into each other list that can hold
        a vector as near as the last of those found: no vector of a list is nearer to the query than the angle between query and
        centroid less the widest angle in the list. Null vectors find nothing.
        """
        q = cut(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec")).where("qvec is not null"))
        found = self._look(q, self.pairs(q, probes), most)
        if exact:
            found = cut(found)
            rest = self.pairs(self.sure(q, found, most), probes, beyond=True)
            found = found.unionByName(self._look(q, rest, most))
        return ranked(found, "similarity", ["vec_id"], most, "dense_rank")

    def tune(self, queries: DataFrame, most: int, recall: float = 0.95) -> int:
        """The least number of probes with which this share of the exact answers to sample queries (query_id, qvec) is found."""
        q = cut(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec")))
        exact = cut(self.topk(q, most, exact=True).select("query_id", "vec_id"))
        lists = self.vectors().select("vec_id", "list").join(bounded(exact), "vec_id")
        turns = self.pairs(q, MOST_LISTS, place=True)
        found = lists.join(turns, ["query_id", "list"]).groupBy("place").count().orderBy("place").collect()  # at most MOST_LISTS
        total, have = sum(r["count"] for r in found), 0
        for r in found:
            have += r["count"]
            if have >= recall * total:
                return r["place"]
        return PROBES

    def sure(self, q: DataFrame, found: DataFrame, most: int) -> DataFrame:
        """q with least, the similarity that a further vector must reach; null where fewer than `most` are found."""
        best = ranked(found, "similarity", ["vec_id"], most, "r").where(F.col("r") == most).select("query_id", F.col("similarity").alias("least"))
        return q.join(best, "query_id", "left")

    def pairs(self, q: DataFrame, probes: int, beyond: bool = False, place: bool = False) -> DataFrame:
        """query_id, list: the lists of the nearest centroids, or those beyond them whose bound reaches `least`. With place also the
        list's turn from 1."""
        about = sorted(self.centroids().collect())  # at most MOST_LISTS
        if not about:
            return self.spark.createDataFrame([], "query_id long, list int, place int" if place else "query_id long, list int")
        ids = np.array([r["list"] for r in about], np.int32)
        centroids = np.array([r["centroid"] for r in about])
        wide = np.arccos(np.clip([r["least_cos"] for r in about], -1, 1))
        columns = ["query_id", "qvec", *(["least"] if beyond else [])]
        found = q.select(*columns).mapInArrow(_probes(ids, centroids, wide, probes, beyond), "query_id long, list int, place int")
        return found if place else found.drop("place")

    def _look(self, q: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
        """The best of each part of each list that a query looks into. Queries of a list are dealt into groups like its vectors."""
        pairs = cut(pairs)
        asked = pairs.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups"))
        about = F.broadcast(self.centroids().select("list", "parts").join(F.broadcast(asked), "list"))  # a row a list
        turn = F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int").alias("turn")
        left = pairs.join(about, "list").select("query_id", "list", turn, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(q, "query_id")
        right = self.vectors().join(about.drop("parts"), "list").select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("turn")).drop("groups")
        by = ["list", "part", "turn"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(most), "query_id long, vec_id long, similarity double")


def _probes(ids: np.ndarray, centroids: np.ndarray, wide: np.ndarray, probes: int, beyond: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            query = b.column(0).to_numpy(zero_copy_only=False)
            sim = _matrix(b.column(1)) @ centroids.T
            order = np.argsort(-sim, axis=1, kind="stable")
            if beyond:
                least = b.column(2).to_numpy(zero_copy_only=False)  # null: nan
                bound = np.cos(np.maximum(0.0, np.arccos(np.clip(sim, -1, 1)) - wide)) + 1e-6
                may = ~(bound < least[:, None])
                np.put_along_axis(may, order[:, :probes], False, axis=1)
                row, col = np.nonzero(may)
            else:
                col = order[:, :probes].ravel()
                row = np.repeat(np.arange(len(query)), min(probes, len(ids)))
            turn = np.empty_like(order)
            np.put_along_axis(turn, order, np.arange(1, len(ids) + 1)[None, :], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(query[row]), pa.array(ids[col]), pa.array(turn[row, col].astype("i4"))], names=["query_id", "list", "place"])

    return run


def _best(most: int):
    """Queries and vectors of one group to the best vectors of each query."""

    def run(asked: pa.Table, vectors: pa.Table) -> pa.Table:
        queries, at, sims = [], [], []
        if asked.num_rows and vectors.num_rows:
            ids, x = vectors["vec_id"].to_numpy(), _matrix(vectors["embedding"])
            who, q = asked["query_id"].to_numpy(), _matrix(asked["qvec"])
            for i in range(0, len(who), BLOCK):
                for query, sim in zip(who[i : i + BLOCK], np.round(q[i : i + BLOCK] @ x.T, 9)):
                    some = np.arange(len(sim))
                    if len(sim) > most:
                        some = np.flatnonzero(sim >= np.partition(sim, len(sim) - most)[len(sim) - most])
                    some = some[np.lexsort((ids[some], -sim[some]))[:most]]
                    queries.append(np.full(len(some), query)), at.append(ids[some]), sims.append(sim[some])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"query_id": join(queries, np.int64), "vec_id": join(at, np.int64), "similarity": join(sims, float)})

    return run
