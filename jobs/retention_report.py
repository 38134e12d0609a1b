"""How deep retrieval must go: for each question and number of hits, the context's tokens, its price, and whether the fact is in it.

    python -m jobs.retention_report --config jobs/retention_report.json --documents IN --questions IN --out OUT

OUT is one Parquet table with a partition for each depth. A run replaces the partitions of the depths that it is given and leaves the
others, so reports can be extended, and a run repeated after a failure gives the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from tessera.functions.text import cost, squash, token_count
from tessera.plans.compress import searched
from tessera.plans.lineage import bounded


@dataclass(frozen=True)
class Config:
    depths: tuple = (1, 5, 10, 20)
    price_per_million: float = 0.15


REPORT = "query_id long, n_hits long, context_tokens long, usd double, first_rank int, retained boolean, depth int"


def report(spark: SparkSession, documents: str, questions: str, out: str, cfg: Config = Config()) -> dict:
    """Writes a row for each question (item_id, text) and depth; what was read and written.

    The text of a question is both the query and the fact that its context must hold, but for case and white space. Hits are the best
    documents (doc_id, text) by BM25, ties by doc_id as text. first_rank is the best hit that holds the fact, or null; a question
    without a hit has a row of no tokens. Null texts are empty; questions of one item_id and rows of one doc_id must be one.
    """
    depths = sorted(set(cfg.depths))
    if not depths or depths[0] < 1:
        raise ValueError("depths are numbers of hits, 1 or more")
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = spark.read.parquet(questions).select(F.col("item_id").cast("long").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    hits = searched(docs, ["doc_id"], lambda index: index.bm25(asked, depths[-1], "rank")).select("query_id", "doc_id", "rank")
    shown = docs.join(bounded(hits), "doc_id").join(bounded(asked), "query_id")
    hit = shown.select("query_id", "rank", token_count(F.col("text")).cast("long").alias("tokens"), F.contains(squash(F.col("text")), squash(F.col("query"))).alias("held"))
    within = hit.select("*", F.explode(F.array(*map(F.lit, depths))).alias("depth")).where("rank <= depth")
    sums = within.groupBy("query_id", "depth").agg(F.count("*").alias("n_hits"), F.sum("tokens").alias("context_tokens"), F.min(F.when(F.col("held"), F.col("rank"))).alias("first_rank"))
    every = asked.select("query_id", F.explode(F.array(*map(F.lit, depths))).alias("depth")).join(sums, ["query_id", "depth"], "left").na.fill(0, ["n_hits", "context_tokens"])
    usd = F.round(cost(F.col("context_tokens"), F.lit(0), cfg.price_per_million, 0.0), 9)
    rows = every.select("query_id", "n_hits", "context_tokens", usd.alias("usd"), F.col("first_rank").cast("int").alias("first_rank"), F.col("first_rank").isNotNull().alias("retained"), "depth")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("depth").parquet(out)

    back = read(spark, out).where(F.col("depth").isin(depths))
    kept = {r["depth"]: (r["n"], r["share"]) for r in back.groupBy("depth").agg(F.count("*").alias("n"), F.avg(F.col("retained").cast("double")).alias("share")).collect()}
    done = {"documents": docs.count(), "questions": asked.count(), "rows_written": sum(n for n, _ in kept.values()), "retained": {d: round(s, 4) for d, (_, s) in sorted(kept.items())}}
    log.info("retention_report %s: %s", out, done)
    return done


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(out)


PATHS = {"documents": "Parquet table of documents", "questions": "Parquet table of questions", "out": "folder of the report"}


def main(argv: list[str] | None = None) -> None:
    command_line("retention_report", PATHS, Config, report, argv)


if __name__ == "__main__":
    main()
