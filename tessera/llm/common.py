"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a broadcast side; above this the operators shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of checkpoints, which executors and driver share. Where none is named, a local session takes a temporary one; a
    cluster has none that all could read."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that executors and driver share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint and lets the shuffle files behind it go."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


class Scratch:
    """Intermediate tables as Parquet in a folder of their own below the shared one; gone at the end, or earlier when dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.saved = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", []

    def __enter__(self) -> Scratch:
        return self

    def save(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        uri = f"{self.folder}/{len(self.saved)}"
        df.write.parquet(uri)
        self.saved.append((self.spark.read.schema(df.schema).parquet(uri), uri))
        return self.saved[-1][0]

    def drop(self, df: DataFrame) -> None:
        """Deletes the table that save() returned; what was made of it must be saved by then."""
        delete(self.spark, next(uri for x, uri in self.saved if x is df))

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)


def delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle and checkpoint files of what is no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(column: str | Column, m: int) -> Column:
    """crc32 of the value's text, modulo m (null: 0)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % m, F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once a row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression takes it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(df: DataFrame, schema: str) -> DataFrame:
    """Only the named columns, cast; a column that lacks is null."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema)))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """big joined with small, which has one row a key: by broadcast when small has at most `rows` rows, else by a shuffle in which
    each key of big is salted over 64 tasks."""
    if fits(small, rows):
        return big.join(F.broadcast(small), on, how)
    salt = spare(big, "salt")
    s = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(63))))
    return big.withColumn(salt, F.pmod(F.xxhash64(*big.columns), F.lit(64)).cast("int")).join(s, [*on, salt], how).drop(salt)


def rank_in_group(df: DataFrame, group: str, salt_key: list[str], order: list[str], out: str, per_cell: int = 500) -> DataFrame:
    """out: the row's place in its group from 0, without gaps. Groups may hold any share of all rows: each is cut into cells of
    about per_cell rows by a hash, cells are counted, and a row's place is its cell's start plus its place in the cell. Rows that
    agree in group, salt_key and order are interchangeable. df is read twice; give it checkpointed."""
    n = df.groupBy(group).agg(F.count("*").alias("_n")).select(group, F.ceil(F.col("_n") / per_cell).cast("int").alias("_cells"))
    big = checked_join(df, n, [group], "inner").withColumn("_cell", F.pmod(F.xxhash64(*salt_key), F.col("_cells")).cast("int")).drop("_cells")
    count = big.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    w = W.Window.partitionBy(group).orderBy("_cell").rowsBetween(W.Window.unboundedPreceding, -1)
    start = count.select(group, "_cell", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    at = W.Window.partitionBy(group, "_cell").orderBy(*order)
    return big.withColumn("_at", F.row_number().over(at)).join(start, [group, "_cell"]).withColumn(out, (F.col("_start") + F.col("_at") - 1).cast("long")).drop("_cell", "_at", "_start")


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def put_file(uri: str, data: bytes) -> None:
    """Writes a whole file so that readers see all or nothing, whichever attempt of a task ends first."""
    p = local_path(uri)
    if p:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        tmp = f"{p}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, p)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{os.urandom(4).hex()}"
    with store.open_output_stream(tmp) as f:
        f.write(data)
    store.move(tmp, path)


def map_file(uri: str, dtype):
    """The file as a memory-mapped array. A store that cannot be mapped is copied to the worker's temporary folder, from which the
    name goes at once, so nothing stays behind."""
    import numpy as np

    p = local_path(uri)
    if p:
        return np.memmap(p, dtype=dtype, mode="r") if os.path.getsize(p) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as out, store.open_input_stream(path) as f:
        while chunk := f.read(1 << 24):
            out.write(chunk)
        out.flush()
        return np.memmap(out, dtype=dtype, mode="r") if out.tell() else np.zeros(0, dtype)
