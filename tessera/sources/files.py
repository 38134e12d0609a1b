"""Reading corpora and writing indexes and events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.chunking import require_chunks


@F.pandas_udf(T.StringType())
def pdf_text(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Page texts of PDF bytes, joined by blank lines; needs the optional library pypdf on the workers."""
    import io

    import pypdf

    for s in data:
        yield pd.Series(["\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(b)).pages) for b in s], dtype=object)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's name without its suffix) and text of the .txt, .md and .pdf files in a folder; an error if there are none.
    Bytes that are not UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,pdf}").load(folder)
    if raw.isEmpty():
        raise FileNotFoundError(f"no .txt, .md or .pdf file in {folder}")
    name = F.substring_index(F.col("path"), "/", -1)
    doc = raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), name.alias("name"), "content")
    plain = doc.where(~F.col("name").endswith(".pdf")).select("doc_id", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    pdf = doc.where(F.col("name").endswith(".pdf"))
    return plain if pdf.isEmpty() else plain.unionByName(pdf.select("doc_id", pdf_text("content").alias("text")))


def write_index(chunks: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a fresh table of chunks, and counts it to verify that no chunk is missing."""
    require_chunks(chunks, least).write.mode("overwrite").parquet(folder)
    there, want = chunks.sparkSession.read.parquet(folder).count(), chunks.count()
    if there != want:
        raise ValueError(f"{want} chunks but {there} written")
    return scan_index(chunks.sparkSession, folder)


def append_index(chunks: DataFrame, folder: str) -> int:
    """Adds chunks to an index; the number of rows by which it grew, which must be that of the chunks."""
    spark = chunks.sparkSession
    before = spark.read.parquet(folder).count()
    chunks.write.mode("append").parquet(folder)
    grown, want = spark.read.parquet(folder).count() - before, chunks.count()
    if grown != want:
        raise ValueError(f"index grew by {grown} rows instead of {want}")
    return grown


def upsert_index(chunks: DataFrame, folder: str) -> int:
    """Puts chunks into an index, in place of those of the same uid; the number of rows by which it grew. The new index is written
    beside the old one and takes its place when it is whole."""
    spark, fresh = chunks.sparkSession, require_chunks(chunks, 0)
    old = spark.read.parquet(folder)
    old.join(fresh.select("uid"), "uid", "left_anti").select(*old.columns).unionByName(fresh).write.mode("overwrite").parquet(f"{folder}.next")
    before, grown = old.count(), spark.read.parquet(f"{folder}.next").count()
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (f"{folder}.next", folder))
    store = to.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(to, True)
    if not store.rename(at, to):
        raise OSError(f"{folder}.next holds the new index; it could not be moved to {folder}")
    spark.catalog.refreshByPath(folder)
    return grown - before


def exact_pattern(path: str) -> str:
    """path as a pattern that matches it alone; a stream takes a single file only by a pattern."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return path if any(c in path for c in "*?[{") else f"{folder}/{{{name}}}" if folder else f"{{{name}}}"


def lookup(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """The chunks of ranked (query_id, uid, rank), each at its rank: ids that the index lacks keep their row, with nulls."""
    return ranked.join(index, "uid", "left")


def scan_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).orderBy("doc_id", "chunk_id")


def write_cache(new: DataFrame, folder: str) -> None:
    """Adds (k, v) rows to a score cache."""
    new.select("k", "v").write.mode("append").parquet(folder)


def eval_results(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation file with available = true, or one row that says why there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.option("multiLine", True).json(path).withColumn("available", F.lit(True))
    return spark.range(1).select(F.lit(False).alias("available"), F.lit("no evaluation results").alias("reason"))


def sse(rows: DataFrame, event: str, columns: list[str]) -> DataFrame:
    """rows with frame: a server-sent event whose data are the columns as JSON."""
    return rows.withColumn("frame", F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(F.struct(*columns)), F.lit("\n\n")))


def latest_filing(filings: DataFrame, form: str = "10-K") -> DataFrame:
    """The first filing of a form from parallel arrays (forms, accessions), dashes stripped; null where there is none."""
    match = F.filter(F.arrays_zip("forms", "accessions"), lambda x: x["forms"] == form)
    return filings.withColumn("accession", F.regexp_replace(F.try_element_at(match, F.lit(1))["accessions"], "-", ""))
