"""The engine as one object: an index folder, a session and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.config import Settings
from tessera.operators import chunking, metrics, retrieval
from tessera.plans import compress as plan
from tessera.sources import files
from tessera.sources.index import ChunkIndex


@dataclass
class Engine:
    """Queries are a table (query_id, query [, budget]) or a list of strings, numbered from 0."""

    spark: SparkSession
    index: str
    cfg: Settings = field(default_factory=Settings)

    def queries(self, asked: DataFrame | list[str]) -> DataFrame:
        if isinstance(asked, DataFrame):
            return asked
        return self.spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")

    def ingest(self, folder: str, least: int | None = None) -> DataFrame:
        """Chunks a folder of documents into a fresh index; its statistics. An error if it has fewer chunks than `least`, by default
        those of the settings."""
        chunks = chunking.chunks(files.read_corpus(self.spark, folder), self.cfg)
        least = self.cfg.min_chunks if least is None else least
        return chunking.ingest_stats(ChunkIndex.create(chunks, self.index, self.cfg.index_buckets, least).chunks())

    def add(self, docs: DataFrame) -> dict[str, int]:
        """Puts documents (doc_id, text) into the index, in place of those of the same doc_id; its chunks before and after."""
        return self.opened().add(docs, chunking.chunks(docs, self.cfg))

    def remove(self, docs: DataFrame) -> dict[str, int]:
        """Takes documents (doc_id) out of the index."""
        return self.opened().remove(docs)

    def opened(self) -> ChunkIndex:
        return ChunkIndex(self.spark, self.index)

    def chunks(self) -> DataFrame:
        return self.opened().chunks()

    def describe(self) -> DataFrame:
        return retrieval.describe(self.chunks())

    def retrieve(self, asked: DataFrame | list[str]) -> DataFrame:
        return plan.retrieve(self.chunks(), self.queries(asked), self.cfg, self.opened().lexical())

    def census(self, asked: DataFrame | list[str]) -> DataFrame:
        return retrieval.census(self.retrieve(asked))

    def compress(self, asked: DataFrame | list[str]) -> plan.Compression:
        return plan.compress(self.chunks(), self.queries(asked), self.cfg, self.opened().lexical())

    def ab(self, paths: DataFrame, price_in: float, price_out: float) -> DataFrame:
        """Distributions of the metrics over clean runs; paths has a row for each run and path."""
        runs = metrics.ab_metrics(metrics.usable_runs(paths), price_in, price_out)
        return metrics.ab_summary(runs, metrics.AB)

    def calibrate(self, samples: DataFrame) -> DataFrame:
        return metrics.calibration(samples)
