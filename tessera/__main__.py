"""python -m tessera ingest | add | describe | retrieve | compress | learn-ends | ab | calibrate: results as JSON lines, or as Parquet with --out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from tessera.config import Settings
from tessera.engine import Engine
from tessera.functions.splitters import LearnedSplitter
from tessera.functions.tokens import RankCounter
from tessera.operators import boundaries
from tessera.sources import events, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, index: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help)
        c.add_argument("--out", help="folder for the result as Parquet")
        if index:
            c.add_argument("--index", required=True)
            c.add_argument("--ranks", nargs="*", default=[], help="rank files of a byte-pair vocabulary; the first that can be read counts the tokens")
            c.add_argument("--pattern", help="pattern that splits texts into words for the rank file")
        return c

    c = command("ingest", "chunk a folder of documents into a fresh index")
    c.add_argument("corpus")
    c.add_argument("--min-chunks", type=int)
    command("add", "put a folder of documents into the index, in place of those of the same name").add_argument("corpus")
    command("describe", "size of the index")
    for name, help in (("retrieve", "fused hits of the queries"), ("compress", "compression summary of the queries")):
        c = command(name, help)
        c.add_argument("query", nargs="+")
        c.add_argument("--top-k", type=int, default=Settings.top_k)
        c.add_argument("--contexts", action="store_true", help="contexts instead of the summary") if name == "compress" else None
        if name == "compress":
            c.add_argument("--budget", type=int, default=Settings.budget, help="tokens; 0 is unlimited")
            c.add_argument("--lambda", dest="mmr_lambda", type=float, default=Settings.mmr_lambda, help="weight of relevance against redundancy")
            c.add_argument("--threshold", type=float, default=Settings.relevance_threshold, help="least relevance")
            c.add_argument("--strip", action="store_true", help="remove filler words from prose")
            c.add_argument("--frames", help="folder for whole results, sentences included, as server-sent events in text files")
            c.add_argument("--ends", help="table of sentence ends that learn-ends wrote; rules without it")
    c = command("learn-ends", "learn where sentences end from a folder of documents", index=False)
    c.add_argument("corpus")
    c.add_argument("--least", type=int, default=5, help="how often something must be seen")
    c = command("ab", "distributions over runs of both paths", index=False)
    c.add_argument("paths", help="Parquet table of runs and paths")
    c.add_argument("--price-in", type=float, required=True)
    c.add_argument("--price-out", type=float, required=True)
    c = command("calibrate", "local against server token counts", index=False)
    c.add_argument("samples", help="Parquet table of local_tokens and server_tokens")
    return p


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    cfg = Settings()
    if getattr(a, "ranks", []):
        if not a.pattern:
            raise ValueError("a rank file needs --pattern")
        cfg = cfg.but(counter=RankCounter.resolve(spark, a.ranks, a.pattern))
    if a.command in ("retrieve", "compress"):
        cfg = cfg.but(top_k=a.top_k)
    if a.command == "compress":
        cfg = cfg.but(budget=a.budget or None, mmr_lambda=a.mmr_lambda, relevance_threshold=a.threshold, strip=a.strip)
        if a.ends:
            cfg = cfg.but(splitter=LearnedSplitter.of(spark.read.parquet(a.ends), a.ends))
    engine = Engine(spark, getattr(a, "index", ""), cfg)
    if a.command == "ingest":
        return engine.ingest(a.corpus, a.min_chunks)
    if a.command == "add":
        return spark.createDataFrame([engine.add(files.read_corpus(spark, a.corpus))])
    if a.command == "describe":
        return engine.describe()
    if a.command == "retrieve":
        return engine.retrieve(a.query).orderBy("query_id", "hit_rank")
    if a.command == "compress":
        done = engine.compress(a.query)
        if a.frames:
            events.write(events.compression_frames(done), a.frames, "overwrite")
        return (done.contexts if a.contexts else done.summary).orderBy("query_id")
    if a.command == "learn-ends":
        return boundaries.learn(files.read_corpus(spark, a.corpus), a.least)
    if a.command == "ab":
        return engine.ab(spark.read.parquet(a.paths), a.price_in, a.price_out)
    return engine.calibrate(spark.read.parquet(a.samples))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    df = result(spark or SparkSession.builder.appName("tessera").getOrCreate(), a)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        for line in df.toJSON().toLocalIterator():  # a row a query or hit, streamed
            sys.stdout.write(line + "\n")


if __name__ == "__main__":
    main()
