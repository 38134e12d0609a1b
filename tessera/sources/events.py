"""Server-sent events in text files: results go out as frames, and frames come back as rows, from a table or as a stream.

A frame is a few lines and a blank one after them. Spark's text source cuts files at blank lines, so that large files are read in parts
and a stream of files has the source's own checkpoint; fields are taken out by expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.plans.compress import Compression

#: The fields of a sentence on the way out, and the column that each is taken from.
SENTENCE = {c: c for c in "sid doc_id chunk_id char_offset text tokens kind relevance ce_norm bm25_norm mmr_score similarity redundant_with selected drop_reason".split()} | {"tokens": "token_count"}
BETWEEN = "\n\n"


def frame(event: str | Column, data: Column) -> Column:
    """One event; data is a struct, written as JSON on one line."""
    name = F.lit(event) if isinstance(event, str) else event
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.to_json(data, {"ignoreNullFields": "false"}), F.lit(BETWEEN))


def sentence_rows(done: Compression) -> DataFrame:
    """query_id and the fields of every candidate sentence."""
    return done.sentences.select("query_id", *(F.col(c).alias(name) for name, c in SENTENCE.items()))


def compression_frames(done: Compression) -> DataFrame:
    """query_id, frame: an event `compression` for each query, with its summary, both contexts and its sentences in document order. A
    query without candidates has no sentences. A query has top_k chunks at most, which bounds its list."""
    fields = F.struct("doc_id", "char_offset", "sid", F.struct(*SENTENCE).alias("s"))
    lists = sentence_rows(done).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x["s"]).alias("sentences"))
    rows = done.summary.join(done.contexts.withColumnRenamed("context", "compressed_context"), "query_id").join(lists, "query_id", "left")
    element = lists.schema["sentences"].dataType.simpleString()
    rows = rows.withColumn("sentences", F.coalesce("sentences", F.array().cast(element)))
    return rows.select("query_id", frame("compression", F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("frame"))


def write(frames: DataFrame, folder: str, mode: str = "error") -> None:
    """The column frame, as text files."""
    body = F.regexp_replace("frame", "\n+$", "")
    frames.select(body.alias("value")).write.mode(mode).option("lineSep", BETWEEN).text(folder)


def parse(frames: DataFrame) -> DataFrame:
    """event, id, data of frames (value). Lines of data are joined; without an event it is a `message`; of several events or ids the
    last counts. Comments, unknown fields and frames without data, null ones too, are left out."""
    lines = F.split(F.regexp_replace("value", r"^\x{FEFF}", ""), "\r\n|\n|\r")

    def field(name: str) -> Column:
        return F.transform(F.filter(lines, lambda x: x.rlike(f"^{name}(:|$)")), lambda x: F.regexp_replace(x, f"^{name}(: ?)?", ""))

    one = lambda name: F.nullif(F.try_element_at(field(name), F.lit(-1)), F.lit(""))
    out = frames.select(F.coalesce(one("event"), F.lit("message")).alias("event"), one("id").alias("id"), field("data").alias("data"))
    return out.where(F.size("data") > 0).withColumn("data", F.array_join("data", "\n"))


def read(spark: SparkSession, path: str, stream: bool = False, files_a_batch: int | None = None) -> DataFrame:
    """The events of text files, as a table or as a stream that takes new files as they come. Lines end with a line feed in the files."""
    source = (spark.readStream if stream else spark.read).option("lineSep", BETWEEN)
    if stream and files_a_batch:
        source = source.option("maxFilesPerTrigger", files_a_batch)
    return parse(source.text(path))


def rows(events: DataFrame, event: str, schema: StructType | str) -> DataFrame:
    """The data of one kind of event as columns; data that is no such JSON gives nulls."""
    return events.where(F.col("event") == event).select(F.from_json("data", schema).alias("x")).select("x.*")
