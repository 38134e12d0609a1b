"""A training-data pipeline over the table documents: each stage reads what the one before it wrote.

Toxic documents go; repeated lines are taken out, and documents without a word left with them; one document of each near-duplicate
class stays; documents that overlap the benchmark go; the rest is packed into sequences of tokens.

All stages but the last return the columns of docs, whatever further ones there are and whatever their names. Null and empty texts pass
all of them and are packed as empty documents; an empty table gives an empty one.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, linededup, ngramjoin, packing, toxicity
from tessera.llm.common import delete, shared_dir, spare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under 0.7. The model learns from the labelled rows of the table documents. Null and empty texts have no
    toxic passage and stay; equal texts have equal scores."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), train=table(spark, sf_dir, "documents"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat earlier ones. A document that loses lines and has no word left is a copy of others and goes;
    null and empty texts, and others that had no word before, stay. Rows that repeat a doc_id share their places."""
    removed = spare(docs, "removed")
    out = linededup.dedup_lines(docs, (spare(docs, "lines"), removed))
    return out.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*(f"`{c}`" for c in docs.columns))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each near-duplicate class. Null and empty texts and null ids are classes of their own; rows
    that repeat a doc_id stay or go together."""
    return ngramjoin.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a verified overlap with an item of the table benchmark. Null and empty texts overlap nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence of at most 2048 tokens; repeated rows are packed as often."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of documents. Every stage but the last is written to the shared folder as Parquet
    and read again, so that a lost executor costs no earlier stage; a stage's table goes when the next one is written, the last one
    with the session."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    atexit.register(_leave, spark, folder)
    return STAGES[-1][1](spark, docs, sf_dir)


def _leave(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        delete(spark, folder)


#: A model and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
