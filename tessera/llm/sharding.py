"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Sizes of input partitions and shards fix the margins of a matrix of counts. Under a uniform shuffle the matrix is multivariate
hypergeometric; it is drawn exactly on the driver (one small row a partition), each partition deals its rows out by a random
permutation of its row of the matrix, rows are exchanged, and each shard permutes what it got. No row is compared with rows of
other partitions before the exchange, and shard sizes come out exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tessera.llm.common import checked_join, checkpoint, quoted, typed

SHARDS = 16
SEED = 20_240_607


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw. numpy samples populations below 10^9; above, the probabilities around the mode are summed and inverted, within 14
    deviations, which leaves out less than a float's rounding."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = ((n + 1) * (good + 1)) // (total + 2)
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    lo, hi = max(0, n - bad, mode - int(14 * sd) - 10), min(n, good, mode + int(14 * sd) + 10)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    return lo + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right").clip(0, hi - lo))


def matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """A random matrix of counts with these margins, distributed as under a uniform shuffle of sum(rows) items."""
    rng = np.random.default_rng(seed)
    left, out = list(map(int, columns)), np.zeros((len(rows), len(columns)), dtype=np.int64)
    for i, n in enumerate(map(int, rows)):
        pool = sum(left)
        for j, c in enumerate(left):
            x = hypergeometric(rng, c, pool - c, n)
            out[i, j], n, pool = x, n - x, pool - c
            left[j] = c - x
            if not n:
                break
    return out


def _deal(counts: dict[int, np.ndarray], seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rng, at = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if labels is None:  # the whole iterator is one partition
                part = b.column(b.num_columns - 1)[0].as_py()
                rng = np.random.default_rng([seed, 1 + part])
                labels = rng.permutation(np.repeat(np.arange(len(counts[part]), dtype=np.int32), counts[part]))
            mine = labels[at : at + b.num_rows]
            at += b.num_rows
            cols = [*b.columns[:-1], pa.array(mine, pa.int32()), pa.array(rng.integers(0, 2**62, b.num_rows), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, per_cell: int = 1000) -> DataFrame:
    """Every row of docs, all its columns, with shard (0..shards-1, sizes at most one apart) and slot (its place in the shard, from 0
    without gaps), uniformly at random for a seed and a division into partitions.

    Columns `shard` and `slot` of the input are replaced; others may have any name, as rows travel as one struct. Nulls, empty and repeated rows are rows like others; an empty
    table gives no rows. The matrix has `shards` integers for each input partition, less than what the driver keeps for a task.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    row = F.struct(*(F.col(quoted(c)) for c in names)) if names else F.struct(F.lit(0))
    kept = checkpoint(docs.select(row.alias("row"), F.spark_partition_id().alias("_part")))
    sizes = {r[0]: r[1] for r in kept.groupBy("_part").count().collect()}
    parts, n = sorted(sizes), sum(sizes.values())
    target = [n // shards + (i < n % shards) for i in range(shards)]
    counts = dict(zip(parts, matrix([sizes[p] for p in parts], target, seed)))
    schema = T.StructType([kept.schema["row"], T.StructField("shard", T.IntegerType()), T.StructField("_u", T.LongType())])
    dealt = kept.mapInArrow(_deal(counts, seed, schema.names), schema)
    # each shard is cut by the random number into cells of about per_cell rows, so that no task orders a whole shard
    cells = max(1, -(-n // (shards * per_cell)))
    dealt = checkpoint(dealt.withColumn("_cell", F.floor(F.col("_u") / F.lit(2.0**62) * cells).cast("int")))
    w = W.Window.partitionBy("shard").orderBy("_cell").rowsBetween(W.Window.unboundedPreceding, -1)
    start = dealt.groupBy("shard", "_cell").count().select("shard", "_cell", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_start"))
    at = W.Window.partitionBy("shard", "_cell").orderBy("_u")
    out = checked_join(dealt.withColumn("_at", F.row_number().over(at)), start, ["shard", "_cell"], "inner")
    slot = (F.col("_start") + F.col("_at") - 1).cast("long")
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "shard", slot.alias("slot"))


def op4_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts are at most one apart."""
    docs = typed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id long, text string")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return shuffle_into_shards(slim).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
