"""A written lexical index, searched by many queries at once.

Items are cut into segments of bounded size, each with its own inverted lists, so that an item's postings stay together: a task scores
the items of a segment for all queries and hands on only the best of each, and no row for a pair of query and item is ever shuffled.
Building is one narrow pass. The index is three Parquet tables in a folder:

segments   partitioned by bucket and kind. kind=items has a row a segment (keys, lens and norms of its items, in the order of their
           keys), kind=postings a row a segment and term, in the order of terms: the places of the items that hold it, its counts
           there, and what bounds its part of a score (the greatest count, the least length).
terms      in how many items each term occurs.
stats      number of items, mean length, mean idf of the vocabulary.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import Settings
from tessera.functions.arrow import slices
from tessera.operators.retrieval import query_terms, ranked

#: Items, and characters of text, of a segment at most (one longer item is a segment of its own).
SEGMENT_ITEMS, SEGMENT_CHARS = 8192, 32 << 20
#: Queries that are worked off in one pass over the index.
PASS = 8192
#: Query terms whose headers are read to prune; with more of them nearly every segment holds one that counts, so nothing is gained.
FEW_TERMS = 64

TERM = re.compile("[a-z0-9]+")
TERMS = "term string, df long"
KINDS = "bucket int, kind string, segment string, term string, places array<int>, counts array<int>, max_count int, min_len int, lens array<int>, norms array<double>"


def _schema(items: DataFrame, key: list[str]) -> T.StructType:
    """The rows of segments: the fixed columns, and keys, an array of the items' keys."""
    s = T._parse_datatype_string(KINDS)
    return s.add(T.StructField("keys", T.ArrayType(T.StructType([T.StructField(k, items.schema[k].dataType) for k in key]))))


class _Held:
    """The items of a segment, as numbers in arrays while they come; a text is counted and let go."""

    def __init__(self) -> None:
        self.keys, self.chars = [], 0
        self.ids: defaultdict[str, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__  # a term's number is its place among those met
        self.at, self.counts, self.sizes, self.lens, self.norms = array("i"), array("i"), array("i"), array("i"), array("d")

    def add(self, key: list, text: str | None) -> None:
        c = Counter(TERM.findall((text or "").lower()))
        self.keys.append(key)
        self.chars += len(text or "")
        self.at.extend(map(self.ids.__getitem__, c))
        self.counts.extend(c.values())
        self.sizes.append(len(c))
        self.lens.append(c.total())
        self.norms.append(math.sqrt(math.sumprod(c.values(), c.values())))


def _segments(key: list[str], arrow: pa.Schema):
    """Batches of (bucket, key, text, gone), in the order of buckets, to rows of segments; a row with gone is no item, but makes sure
    that its bucket has a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held, of = _Held(), None
        for b in slices(batches):
            for bucket, *k, text, gone in zip(*(c.to_pylist() for c in b.columns)):
                if of is not None and (bucket != of or len(held.keys) >= SEGMENT_ITEMS or (held.keys and held.chars + len(text or "") > SEGMENT_CHARS)):
                    yield from _segment(of, f"{of}-{part}-{made}", held, key, arrow)
                    held, made = _Held(), made + 1
                of = bucket
                if not gone:
                    held.add(k, text)
        if of is not None:
            yield from _segment(of, f"{of}-{part}-{made}", held, key, arrow)

    return run


def _segment(bucket: int, name: str, held: _Held, key: list[str], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    # Spark's order of keys: nulls first, strings by code point
    by_key = sorted(range(len(held.keys)), key=lambda i: [(v is not None, v) for v in held.keys[i]])
    ids, turn = held.ids, np.array(by_key, np.int64)
    length, norms = np.array(held.lens, np.int32)[turn], np.array(held.norms)[turn]
    cols = {n: pa.nulls(1, arrow.field(n).type) for n in arrow.names}
    cols |= {"lens": pa.array([length], pa.list_(pa.int32())), "norms": pa.array([norms], pa.list_(pa.float64())), "keys": pa.array([[dict(zip(key, held.keys[i])) for i in by_key]], arrow.field("keys").type)}
    yield _rows(cols, bucket, "items", name, arrow)

    if not ids:  # a row of no term, so that this bucket's older lists give way
        cols = {n: pa.nulls(1, arrow.field(n).type) for n in arrow.names}
        yield _rows(cols, bucket, "postings", name, arrow)
        return
    names = sorted(ids)
    rank = np.empty(len(names), np.int32)
    rank[[ids[t] for t in names]] = np.arange(len(names))
    place_of = np.empty(len(turn), np.int32)
    place_of[turn] = np.arange(len(turn))
    term, place = rank[np.frombuffer(held.at, np.int32)], np.repeat(place_of, np.frombuffer(held.sizes, np.int32))
    order = np.lexsort((place, term))  # places of a term ascend
    place, count = place[order], np.frombuffer(held.counts, np.int32)[order]
    ends = np.searchsorted(term[order], np.arange(len(names) + 1)).astype(np.int32)
    del term, order
    step = 4096
    for i in range(0, len(names), step):
        e = ends[i : i + step + 1]
        lo, hi, cut = e[0], e[-1], pa.array(e - e[0])
        cols = {n: pa.nulls(len(e) - 1, arrow.field(n).type) for n in arrow.names}
        cols |= {
            "term": pa.array(names[i : i + step]),
            "places": pa.ListArray.from_arrays(cut, pa.array(place[lo:hi])),
            "counts": pa.ListArray.from_arrays(cut, pa.array(count[lo:hi])),
            "max_count": pa.array(np.maximum.reduceat(count[lo:hi], e[:-1] - lo)),
            "min_len": pa.array(np.minimum.reduceat(length[place[lo:hi]], e[:-1] - lo)),
        }
        yield _rows(cols, bucket, "postings", name, arrow)


def _rows(cols: dict, bucket: int, kind: str, name: str, arrow: pa.Schema) -> pa.RecordBatch:
    n = len(cols["places"])
    cols |= {"bucket": pa.array([bucket] * n, pa.int32()), "kind": pa.array([kind] * n), "segment": pa.array([name] * n)}
    return pa.RecordBatch.from_arrays([cols[c].cast(arrow.field(c).type) for c in arrow.names], schema=arrow)


def build(items: DataFrame, key: list[str], folder: str, bucket: Column | None = None) -> LexicalIndex:
    """Writes the index of items (key, text) into folder, replacing what is there.

    key, one or more columns of strings or whole numbers, names an item and breaks ties; null texts are empty; items without a term are
    kept, as BM25 counts them. With bucket, an expression of items, the segments of each bucket can be replaced alone.
    """
    b = F.lit(0) if bucket is None else bucket
    _put(_rows_of(items, key, b), key, folder, bucket is not None, "static")
    return _refresh(items.sparkSession, folder, _schema(items, key))


def replace(items: DataFrame, key: list[str], folder: str, bucket: Column, emptied: DataFrame | None = None) -> LexicalIndex:
    """Puts items into an index that was built with bucket: each bucket that items has rows of is replaced as a whole by Spark's
    writer, and so is each of emptied (bucket), which is left without items; other buckets stay as they are."""
    rows = _rows_of(items, key, bucket)
    if emptied is not None:
        none = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in [*key, "text"]]
        rows = rows.union(emptied.select(F.col("bucket").cast("int"), *none, F.lit(True)))
    _put(rows, key, folder, True, "dynamic")
    return _refresh(items.sparkSession, folder, _schema(items, key))


def _rows_of(items: DataFrame, key: list[str], bucket: Column) -> DataFrame:
    return items.select(bucket.cast("int").alias("_bucket"), *key, "text", F.lit(False).alias("_gone"))


def _put(rows: DataFrame, key: list[str], folder: str, by_bucket: bool, mode: str) -> None:
    from pyspark.sql.pandas.types import to_arrow_schema

    if by_bucket:
        rows = rows.repartition("_bucket").sortWithinPartitions("_bucket")
    schema = _schema(rows, key)
    made = rows.mapInArrow(_segments(key, to_arrow_schema(schema)), schema)
    made.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket", "kind").parquet(f"{folder}/segments")


def _refresh(spark: SparkSession, folder: str, schema: T.StructType) -> LexicalIndex:
    """Counts terms and sizes of the segments anew."""
    seg = spark.read.schema(schema).parquet(f"{folder}/segments")
    terms = seg.where("kind = 'postings' and term is not null").groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df"))
    terms.write.mode("overwrite").parquet(f"{folder}/terms")
    # lens come to some bytes an item; their sums, and idf's, are one row
    size = seg.where("kind = 'items'").agg(F.coalesce(F.sum(F.size("lens")), F.lit(0)).alias("n"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    df = spark.read.schema(TERMS).parquet(f"{folder}/terms")
    # an idf times its number of terms: a sum of millions of idf is off by what the last digits of a score show
    alike = df.groupBy("df").agg(F.count("*").alias("m"))
    mean = alike.agg((F.sum(_idf(F.lit(size.first()["n"]), F.col("df")) * F.col("m")) / F.sum("m")).alias("mean_idf"))
    stats = size.select("n", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("avgdl")).crossJoin(mean)
    # a column of the keys' type, so that an index without items has it too
    stats.withColumn("keys", F.lit(None).cast(schema["keys"].dataType)).write.mode("overwrite").parquet(f"{folder}/stats")
    return LexicalIndex(spark, folder)


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


@dataclass(frozen=True)
class Weights:
    """A pass's queries, ready to be broadcast: ids, norms, and for each query its term numbers and weights."""

    ids: list
    norms: np.ndarray
    terms: dict[str, int]
    lists: list[tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class LexicalIndex:
    """An index in a folder; queries are tables (query_id, query)."""

    spark: SparkSession
    folder: str

    def segments(self) -> DataFrame:
        schema = T._parse_datatype_string(KINDS).add(self.stats().schema["keys"])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/segments")

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/stats")

    def key(self) -> list[T.StructField]:
        return self.stats().schema["keys"].dataType.elementType.fields

    def bm25(self, queries: DataFrame, most: int, out: str = "bm25_rank", zero: bool = False, cfg: Settings = Settings()) -> DataFrame:
        """query_id, key, bm25_raw and the rank: the best `most` items of each query that hold one of its terms, ties by key. With
        zero, items without a term follow at score 0. A query term in over half of the items has epsilon times the mean idf."""
        s = self.stats().first()
        best = None
        for part in self._passes(queries):
            w = self._weights(part, s, cfg)
            score = _bm25(s["avgdl"] or 1.0, cfg)
            found = self._best(w, part, score, most, zero, None if zero else self._bounded(part, w, score, most))
            best = found if best is None else best.union(found)
        return ranked(best.withColumnRenamed("score", "bm25_raw"), "bm25_raw", [f.name for f in self.key()], most, out)

    def cosine(self, queries: DataFrame, most: int, out: str = "dense_rank") -> DataFrame:
        """query_id, key, similarity and the rank: by the cosine of term-frequency vectors, of items that share a term."""
        best = None
        for part in self._passes(queries):
            found = self._best(self._weights(part, None, None), part, _cosine, most, False, None)
            best = found if best is None else best.union(found)
        return ranked(best.withColumnRenamed("score", "similarity"), "similarity", [f.name for f in self.key()], most, out)

    def _passes(self, queries: DataFrame) -> Iterator[DataFrame]:
        """The queries' terms (query_id, term, qtf), some PASS queries at a time; a query without terms has a row of a null term."""
        passes = max(1, -(-queries.count() // PASS))
        for k in range(passes):
            of = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k)
            yield of.select("query_id").distinct().join(query_terms(of), "query_id", "left")

    def _weights(self, part: DataFrame, stats, cfg: Settings | None) -> Weights:
        """With stats, weights of BM25, else term counts. A pass has at most PASS queries, which the driver and each task hold."""
        known = self.spark.read.schema(TERMS).parquet(f"{self.folder}/terms")
        asked = part.join(known, "term", "left").collect()
        ids = sorted({r["query_id"] for r in asked})
        terms = {t: i for i, t in enumerate(sorted({r["term"] for r in asked if r["df"]}))}
        rows: dict = {q: [] for q in ids}
        square = dict.fromkeys(ids, 0)
        for r in asked:
            square[r["query_id"]] += (r["qtf"] or 0) ** 2
            if r["df"]:
                weight = float(r["qtf"])
                if stats is not None:
                    idf = np.log(stats["n"] - r["df"] + 0.5) - np.log(r["df"] + 0.5)
                    weight *= idf if idf >= 0 else cfg.epsilon * stats["mean_idf"]
                rows[r["query_id"]].append((terms[r["term"]], weight))
        lists = []
        for q in ids:
            x = sorted(rows[q])
            lists.append((np.array([t for t, _ in x], np.int64), np.array([w for _, w in x])))
        return Weights(ids, np.sqrt(np.array([square[q] for q in ids], float)), terms, lists)

    def _bounded(self, part: DataFrame, w: Weights, score, most: int) -> DataFrame | None:
        """(query_id, segment) pairs that can hold one of a query's best: those whose bound reaches what is certain already.

        A segment's bound for a query is the sum over its terms of weight times the part that the greatest count in the shortest item
        would have. The segment of the greatest bound is searched first, and its `most`-th best score is what a query is certain of.
        None where there is nothing to gain (many terms) or where a weight is negative, so that sums of parts bound nothing.
        """
        if len(w.terms) > FEW_TERMS or not w.terms or any((x < 0).any() for _, x in w.lists):
            return None
        numbers = [(q, t, float(x)) for q, (ts, xs) in zip(w.ids, w.lists) for t, x in zip(_names(w, ts), xs)]
        of = self.spark.createDataFrame(numbers, T.StructType([part.schema["query_id"], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))
        heads = self.segments().where("kind = 'postings'").where(F.col("term").isin(list(w.terms))).select("segment", "term", "max_count", "min_len")
        bound = F.sum(F.col("weight") * score.column(F.col("max_count"), F.col("min_len")))
        bounds = heads.join(F.broadcast(of), "term").groupBy("query_id", "segment").agg((bound + 1e-6).alias("bound"))
        first = bounds.groupBy("query_id").agg(F.max_by("segment", F.struct("bound", "segment")).alias("segment"))
        sure = self._best(w, part, score, most, False, first).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        sure = sure.where(F.col("n") >= most).select("query_id", "least")
        return bounds.join(sure, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query_id", "segment")

    def _best(self, w: Weights, part: DataFrame, score, most: int, zero: bool, pairs: DataFrame | None) -> DataFrame:
        """query_id, key, score: the best of each segment for each query, or for the pairs (query_id, segment) alone."""
        seg = self.segments()
        # only lists of the queries' terms leave the scan, by the filter on terms or, where they are many, by a hash set
        if len(w.terms) <= FEW_TERMS:
            lists = seg.where("kind = 'postings'").where(F.col("term").isin(list(w.terms)))
        else:
            names = self.spark.createDataFrame([(t,) for t in w.terms], "term string")
            lists = seg.where("kind = 'postings'").join(F.broadcast(names), "term", "left_semi")
        have = ["segment", "term", "places", "counts", "lens", "norms", "keys"]
        items = seg.where("kind = 'items'").select(*have)
        rows = lists.select(*have).withColumn("asked", F.lit(None).cast("array<string>"))
        if pairs is not None:
            asked = pairs.groupBy("segment").agg(F.collect_set(F.col("query_id").cast("string")).alias("asked"))  # at most PASS
            items = items.join(asked, "segment")
            rows = rows.join(asked.select("segment"), "segment", "left_semi")
        else:
            items = items.withColumn("asked", F.lit(None).cast("array<string>"))
        key = self.key()
        out = T.StructType([part.schema["query_id"], *key, T.StructField("score", T.DoubleType())])
        sent = self.spark.sparkContext.broadcast(w)
        return items.unionByName(rows).groupBy("segment").applyInArrow(_search(sent, score, most, zero, [f.name for f in key], out), out)


def _names(w: Weights, numbers: np.ndarray) -> list[str]:
    names = list(w.terms)
    return [names[i] for i in numbers]


class _bm25:
    """A term's part of a score, but for the query's weight of it."""

    def __init__(self, avgdl: float, cfg: Settings):
        self.avgdl, self.k1, self.b = avgdl, cfg.k1, cfg.b

    def column(self, count: Column, length: Column) -> Column:
        return count * (self.k1 + 1) / (count + self.k1 * (1 - self.b + self.b * length / self.avgdl))

    def __call__(self, count, length):
        return count * (self.k1 + 1) / (count + self.k1 * (1 - self.b + self.b * length / self.avgdl))


def _cosine(count, length):
    return count


def _search(sent, score, most: int, zero: bool, key: list[str], out: T.StructType):
    """The rows of one segment to the best of its items for each query."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(rows: pa.Table) -> pa.Table:
        w = sent.value
        head = rows.filter(pa.compute.is_valid(rows["lens"])).combine_chunks()
        if head.num_rows == 0:
            return arrow.empty_table()
        keys, lens = head["keys"][0].values.flatten(), head["lens"][0].values.to_numpy()
        norms = head["norms"][0].values.to_numpy()
        asked = None if head["asked"][0].as_py() is None else set(head["asked"][0].as_py())
        parts = {}
        lists = rows.filter(pa.compute.is_valid(rows["places"])).combine_chunks()
        for name, places, counts in zip(lists["term"].to_pylist(), lists["places"], lists["counts"]):
            at = places.values.to_numpy()
            parts[w.terms[name]] = at, score(counts.values.to_numpy().astype(float), lens[at])
        queries, at, scores = [], [], []
        for q, norm, (terms, weights) in zip(w.ids, w.norms, w.lists):
            if asked is not None and str(q) not in asked:
                continue
            total, held = np.zeros(len(lens)), np.full(len(lens), zero)
            for t, x in zip(terms.tolist(), weights.tolist()):
                if t in parts:
                    places, part = parts[t]
                    total[places] += x * part
                    held[places] = True
            found = np.flatnonzero(held)
            s = total[found]
            s = np.round(s / (norms[found] * norm) if score is _cosine else s, 9)
            if len(s) > most:
                keep = s >= np.partition(s, len(s) - most)[len(s) - most]
                s, found = s[keep], found[keep]
            order = np.lexsort((found, -s))[:most]  # places are in the order of keys
            queries.extend([q] * len(order)), at.append(found[order]), scores.append(s[order])
        if not queries:
            return arrow.empty_table()
        at = pa.array(np.concatenate(at))
        cols = [pa.array(queries, arrow.field(0).type), *(c.take(at) for c in keys), pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(cols, arrow.types)], schema=arrow)

    return run
