"""Keeps a corpus of chunks up to date with a folder to which files of documents are added.

    python -m jobs.ingest_stream --config jobs/ingest_stream.json --documents IN --out OUT --checkpoint STATE

A file stream takes the files that STATE has not seen, in batches of files_per_batch, and stops when there are none left. Each batch
is one partition of two tables below OUT: chunks (the documents' chunks) and ledger (every document that the batch held, with the
number and tokens of its chunks). A batch that is run again after a failure replaces its own partitions and nothing else. A document
that comes again, in a later batch, replaces its older text: current() shows the chunks of each document's latest batch, none if that
text is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from tessera.config import Settings
from tessera.operators import chunking
from tessera.sources.files import exact_pattern


@dataclass(frozen=True)
class Config:
    chunk_tokens: int = Settings.chunk_tokens
    overlap: float = Settings.overlap
    line_paragraphs: bool = False  # every line of a text is a paragraph
    files_per_batch: int = 1000


CHUNKS = "doc_id string, chunk_id int, char_offset int, text string, token_count int, batch long"
LEDGER = "doc_id string, n_chunks long, n_tokens long, batch long"


def ingest(spark: SparkSession, documents: str, out: str, checkpoint: str, cfg: Config = Config()) -> list[dict]:
    """Brings the tables below out up to date with the Parquet files at documents; what each batch read and wrote.

    documents (doc_id, text; other columns are ignored) is a file, or a folder of files, read by Spark. Rows of one doc_id in a batch
    are one document, of the greatest text; a null text is empty; rows without doc_id are left out and counted in the log.
    """
    settings = Settings().but(chunk_tokens=cfg.chunk_tokens, overlap=cfg.overlap)
    done: list[dict] = []

    def batch(rows: DataFrame, epoch: int) -> None:
        text = F.coalesce(F.max("text"), F.lit(""))
        docs = rows.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(text.alias("text"))
        if cfg.line_paragraphs:
            docs = docs.withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
        chunks = chunking.chunks(docs, settings).drop("uid").withColumn("batch", F.lit(epoch).cast("long"))
        _put(chunks, f"{out}/chunks")
        written = table(spark, f"{out}/chunks", CHUNKS).where(F.col("batch") == epoch)
        sizes = written.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").cast("long").alias("n_tokens"))
        ledger = docs.select("doc_id").join(sizes, "doc_id", "left").na.fill(0, ["n_chunks", "n_tokens"]).withColumn("batch", F.lit(epoch).cast("long"))
        _put(ledger, f"{out}/ledger")
        read, nameless = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
        n, c, t = table(spark, f"{out}/ledger", LEDGER).where(F.col("batch") == epoch).agg(F.count("*"), F.sum("n_chunks"), F.sum("n_tokens")).first()
        done.append({"batch": epoch, "rows_read": read, "rows_without_id": nameless, "documents": n, "chunks_written": c or 0, "tokens": t or 0})
        log.info("ingest_stream %s", done[-1])

    schema = spark.read.parquet(documents).select("doc_id", "text").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", cfg.files_per_batch).parquet(exact_pattern(documents))
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("ingest_stream %s: %d new batches from %s", out, len(done), documents)
    return done


def _put(rows: DataFrame, folder: str) -> None:
    """Writes rows in place of the partitions (batch) that they belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each document's latest batch, with that batch's number."""
    latest = table(spark, f"{out}/ledger", LEDGER).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return table(spark, f"{out}/chunks", CHUNKS).join(latest, ["doc_id", "batch"])


PATHS = {"documents": "Parquet file or folder of documents", "out": "folder of the chunk tables", "checkpoint": "folder of the stream's state"}


def main(argv: list[str] | None = None) -> None:
    command_line("ingest_stream", PATHS, Config, ingest, argv)


if __name__ == "__main__":
    main()
