"""Contexts put together again in source order, with citations and marks of what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.config import Settings
from tessera.functions.text import strip_filler


def stripped(selected: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """selected with the text to show: filler words removed from prose when the settings say so."""
    if not cfg.strip:
        return selected.withColumn("shown", F.col("text"))
    return selected.withColumn("shown", F.when(F.col("kind") == "prose", strip_filler(F.col("text"), cfg.legacy_strip)).otherwise(F.col("text")))


def strip_savings(shown: DataFrame, by: list[str], cfg: Settings = Settings()) -> DataFrame:
    """Tokens that stripping saved in each query; null when it did not run."""
    saved = F.sum(cfg.counter.column(F.col("text")) - cfg.counter.column(F.col("shown"))) if cfg.strip else F.max(F.lit(None).cast("long"))
    return shown.groupBy(*by).agg(saved.cast("long").alias("strip_tokens_saved"))


def compressed(shown: DataFrame, by: list[str], cfg: Settings = Settings()) -> DataFrame:
    """by, context: documents in order of their id, sentences by offset (then mmr_rank), a [...] line where text is left out."""
    w = W.Window.partitionBy(*by, "doc_id").orderBy("char_offset", "mmr_rank")
    end = F.lag(F.col("char_offset") + F.length("shown")).over(w)
    gap = F.col("char_offset") > end
    if cfg.elide_only_if_dropped:  # nothing but white space lies between sentences with neighbouring indices of one chunk
        gap = gap & ~((F.lag("chunk_id").over(w) == F.col("chunk_id")) & (F.lag("sentence_index").over(w) + 1 == F.col("sentence_index")))
    lines = shown.withColumn("_n", F.row_number().over(w)).withColumn("_line", F.when(F.coalesce(gap, F.lit(False)), F.concat(F.lit("[...]\n"), F.col("shown"))).otherwise(F.col("shown")))
    joined = lambda items, sep: F.array_join(F.transform(F.array_sort(items), lambda x: x["t"]), sep)
    docs = lines.groupBy(*by, "doc_id").agg(F.collect_list(F.struct("_n", F.col("_line").alias("t"))).alias("l"))
    docs = docs.withColumn("t", F.concat(F.lit("[SOURCE: "), F.col("doc_id"), F.lit("]\n"), joined(F.col("l"), "\n")))
    return docs.groupBy(*by).agg(joined(F.collect_list(F.struct("doc_id", "t")), "\n\n").alias("context"))


def baseline(hits: DataFrame) -> DataFrame:
    """query_id, context: the retrieved chunks in order of rank, each under its source."""
    one = F.struct("hit_rank", F.concat(F.lit("[SOURCE: "), F.col("doc_id"), F.lit("]\n"), F.col("text")).alias("t"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n\n").alias("context"))
