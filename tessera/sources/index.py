"""A chunk index that documents can be added to, replaced in and removed from: chunks and their lexical index, by buckets of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.operators.lexical import LexicalIndex
from tessera.plans.lineage import bounded, cut

KEY = ["doc_id", "chunk_id"]
CHUNKS = "doc_id string, chunk_id int, char_offset int, text string, token_count int, uid long, bucket int"


@dataclass(frozen=True)
class ChunkIndex:
    """Tables below folder: chunks, partitioned by bucket (a hash of doc_id), lexical, and layout with the number of buckets.

    A change rewrites the buckets of the documents that it names and no others, each by Spark's writer and its dynamic partition
    overwrite. A change that fails half-way can be run again: it leads to the same index. Readers should not be under way meanwhile.
    """

    spark: SparkSession
    folder: str

    @classmethod
    def create(cls, chunks: DataFrame, folder: str, buckets: int, least: int = 0) -> ChunkIndex:
        """Writes a fresh index of chunks (doc_id, chunk_id, char_offset, text, token_count, uid), replacing what is there. An error
        if there are fewer than least, if a key comes twice, or if not all that was made is there afterwards."""
        index = cls(chunks.sparkSession, folder)
        index.spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/layout")
        made = index._put(chunks, "static")
        index._verify(made, least)
        lexical.build(index.chunks(), KEY, f"{folder}/lexical", F.col("bucket"))
        return index

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(CHUNKS).parquet(f"{self.folder}/chunks").where("chunk_id is not null")

    def lexical(self) -> LexicalIndex:
        return LexicalIndex(self.spark, f"{self.folder}/lexical")

    def add(self, docs: DataFrame, chunks: DataFrame) -> dict[str, int]:
        """Puts the documents docs (doc_id) in, with their chunks, in place of all chunks that the index has of them: a document that
        became shorter leaves none behind, one without chunks is removed. The numbers of chunks before and after."""
        before = self.chunks().count()
        names = cut(docs.select("doc_id").where("doc_id is not null").distinct())
        touched = [r[0] for r in names.select(self._bucket()).distinct().collect()]  # at most the buckets
        old = self.chunks().where(F.col("bucket").isin(touched)).drop("bucket").join(bounded(names), "doc_id", "left_anti")
        new = cut(old.unionByName(chunks.select(*old.columns)))  # it must not depend on the files that it will replace
        full = {r[0] for r in new.select(self._bucket()).distinct().collect()}
        emptied = self.spark.createDataFrame([(b,) for b in touched if b not in full], "bucket int")
        made = self._put(new, "dynamic", emptied)
        have = self.chunks().where(F.col("bucket").isin(touched))
        _same(made, have.count(), have)
        lexical.replace(new, KEY, f"{self.folder}/lexical", self._bucket(), emptied)
        return {"before": before, "after": self.chunks().count()}

    def remove(self, docs: DataFrame) -> dict[str, int]:
        """Takes the documents docs (doc_id) out."""
        return self.add(docs, self.chunks().drop("bucket").limit(0))

    def _bucket(self) -> Column:
        n = self.spark.read.parquet(f"{self.folder}/layout").first()["buckets"]
        return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket")

    def _put(self, chunks: DataFrame, mode: str, emptied: DataFrame | None = None) -> int:
        """Writes chunks and, for each emptied bucket, a row of nulls that stands for it; how many chunks there were."""
        seen = Observation()
        rows = chunks.select("*", self._bucket()).observe(seen, F.count("*").alias("n"))
        if emptied is not None:
            rows = rows.unionByName(emptied, allowMissingColumns=True)
        ordered = rows.repartition("bucket").sortWithinPartitions("bucket", *KEY)
        ordered.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(f"{self.folder}/chunks")
        return seen.get["n"]

    def _verify(self, made: int, least: int) -> None:
        have = self.chunks()
        n = have.count()
        if n < least:
            raise ValueError(f"{n} chunks indexed, {least} needed")
        _same(made, n, have)


def _same(made: int, there: int, chunks: DataFrame) -> None:
    if there != made:
        raise ValueError(f"{made} chunks written but {there} in the index")
    twice = chunks.groupBy(*KEY).count().where("count > 1").first()
    if twice:
        raise ValueError(f"chunk {twice['doc_id']}#{twice['chunk_id']} comes {twice['count']} times")
