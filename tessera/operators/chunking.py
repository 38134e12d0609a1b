"""Documents to blocks, chunks and sentence units: one narrow pass in Arrow batches, then relational operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tessera.config import Settings
from tessera.functions import segment
from tessera.functions.arrow import slices
from tessera.functions.text import has_word, informative_short, squash


def _apply(fn, schema: str):
    """A column function that maps each text to a list of rows. A batch of texts is worked off slice by slice, so that what a task holds
    beside it is the rows of a few texts."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T._parse_datatype_string(f"array<struct<{schema}>>")
    rows = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in slices(texts):
            yield pa.array([fn(t or "") for t in s.to_pylist()], rows)

    return run


def blocks(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, block_id, char_offset, text, is_table, token_count."""
    f = _apply(lambda t: [(b.text, b.offset, b.table) for b in segment.blocks(t)], "text: string, char_offset: int, is_table: boolean")
    b = docs.select("doc_id", F.posexplode(f("text")).alias("block_id", "b"))
    return b.select("doc_id", "block_id", "b.char_offset", "b.text", "b.is_table").withColumn("token_count", cfg.counter.column(F.col("text")))


def chunks(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, chunk_id, char_offset, text, token_count, uid."""
    f = _apply(lambda t: segment.chunks(t, cfg.chunk_tokens, cfg.overlap, cfg.legacy_overlap, cfg.counter.count), "char_offset: int, text: string, token_count: int")
    c = docs.select("doc_id", F.posexplode(f("text")).alias("chunk_id", "c"))
    return c.select("doc_id", "chunk_id", "c.char_offset", "c.text", "c.token_count").withColumn("uid", F.xxhash64("doc_id", "chunk_id"))


def ingest_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"), F.avg("token_count").alias("mean_tokens"))


def require_chunks(chunks: DataFrame, least: int) -> DataFrame:
    """chunks, or an error when there are fewer than `least` or two of one document and number."""
    n, ids = chunks.agg(F.count("*"), F.countDistinct("doc_id", "chunk_id")).first()
    if n < least:
        raise ValueError(f"{n} chunks indexed, {least} needed")
    if ids != n:
        raise ValueError(f"{n} chunks but {ids} of different document or number")
    return chunks


def sentence_units(chunks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Informative typed units of chunks: doc_id, chunk_id, sentence_index (with gaps where units were dropped), sid, text,
    char_offset, token_count, kind."""
    f = _apply(lambda t: segment.units(t, 0, cfg.splitter.ends), "text: string, at: int, kind: string")
    u = chunks.select("doc_id", "chunk_id", "char_offset", F.posexplode(f("text")).alias("sentence_index", "u"))
    u = u.select("doc_id", "chunk_id", "sentence_index", "u.text", (F.col("char_offset") + F.col("u.at")).alias("char_offset"), "u.kind")
    u = u.withColumn("token_count", cfg.counter.column(F.col("text")))
    body = F.regexp_replace("text", r"\[/?TABLE\]", "") if cfg.filter_table_body else F.col("text")
    keep = F.when(F.col("kind") == "prose", (F.col("token_count") >= cfg.min_sentence_tokens) | informative_short(F.col("text"))).otherwise(has_word(body))
    sid = F.concat("doc_id", F.lit("#"), F.col("chunk_id").cast("string"), F.lit("."), F.col("sentence_index").cast("string"))
    return u.where(keep).withColumn("sid", sid)


def exact_dedup(sentences: DataFrame, by: list[str]) -> DataFrame:
    """The first of the sentences that agree but for case and white space, by (doc_id, char_offset), then by retrieval order."""
    ties = [c for c in ("hit_rank", "chunk_id", "sentence_index") if c in sentences.columns]
    # an aggregation combines before the shuffle, so the commonest line of a corpus is no hot task
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in sentences.columns)), F.struct("doc_id", "char_offset", *ties))
    keyed = sentences.groupBy(*by, squash(F.col("text")).alias("_squashed")).agg(first.alias("_first"))
    return keyed.select(*(F.col("_first").getField(c).alias(c) for c in sentences.columns))


def with_order(sentences: DataFrame, by: list[str]) -> DataFrame:
    """cand_idx: the canonical order that breaks every later tie."""
    w = W.Window.partitionBy(*by).orderBy("doc_id", "char_offset", "sentence_index", "chunk_id")
    return sentences.withColumn("cand_idx", F.row_number().over(w))
