"""The stages in SQL: functions that spark.sql finds after register(spark).

    select d.doc_id, c.* from docs d, lateral tessera_chunks(d.text) c
    select u.* from chunks c, lateral tessera_units(c.text) u where tessera_has_word(u.text)
    select * from tessera_knapsack(table(candidates))

Scalar functions are expressions, written into the plan like any other. Those of a text run on rows, of which Spark hands on some hundred
at a time, as an Arrow batch of texts would be held whole; the knapsack's short rows come in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, StructType

from tessera.config import Settings
from tessera.functions import segment
from tessera.functions.text import TOKEN

#: Name, result and body of the scalar functions, each of one text t.
SCALAR = {
    "tessera_terms": ("array<string>", "regexp_extract_all(lower(t), '[a-z0-9]+', 0)"),
    "tessera_tokens": ("int", f"size(regexp_extract_all(t, r'{TOKEN}', 0))"),
    "tessera_squash": ("string", r"lower(trim(regexp_replace(t, r'[\s\p{Z}]+', ' ')))"),
    "tessera_has_word": ("boolean", "t rlike '[A-Za-z]{2,}'"),
}


class Knapsack:
    """Rows of a table (query_id, place, token_count, budget, whatever else) with `selected`: along place, the first row of a query is
    taken, each further one if it fits into what is left of the budget. A null budget is unlimited; of rows that share a place one
    comes first. Spark brings a query's rows in order, so that a task keeps a number, not rows."""

    def __init__(self) -> None:
        self.used = None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("tessera_knapsack takes a table")
        lacking = [c for c in ("query_id", "place", "token_count", "budget") if c not in rows.dataType.fieldNames()]
        if lacking or "selected" in rows.dataType.fieldNames():
            raise ValueError(f"the table lacks {', '.join(lacking)}" if lacking else "the table has a column selected")
        schema = StructType(list(rows.dataType.fields)).add("selected", BooleanType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("query_id")], orderBy=[OrderingColumn("place")])

    def eval(self, row: Row) -> Iterator[tuple]:
        n, cap = row["token_count"] or 0, row["budget"]
        fits = self.used is None or cap is None or self.used + n <= cap
        self.used = (self.used or 0) + (n if fits else 0)
        yield (*row, fits)


def register(spark: SparkSession, cfg: Settings = Settings()) -> None:
    """Registers the functions for this session, in place of those of an earlier call; tokens, chunks and sentences are as the settings
    have them. A null text has no chunks and no units; such rows are lost by `left join lateral` too, as Spark 4.1 has it for table
    functions in Python."""

    class Chunks:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, (at, body, n) in enumerate(segment.chunks(text or "", cfg.chunk_tokens, cfg.overlap, cfg.legacy_overlap, cfg.counter.count)):
                yield i, at, body, n

    class Units:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, (unit, at, kind) in enumerate(segment.units(text or "", 0, cfg.splitter.ends)):
                yield i, unit, at, kind, cfg.counter.count(unit)

    spark.udtf.register("tessera_chunks", udtf(Chunks, returnType="chunk_id int, char_offset int, text string, token_count int", useArrow=False))
    spark.udtf.register("tessera_units", udtf(Units, returnType="sentence_index int, text string, at int, kind string, token_count int", useArrow=False))
    spark.udtf.register("tessera_knapsack", udtf(Knapsack, useArrow=True))
    for name, (kind, body) in SCALAR.items():
        spark.sql(f"create or replace temporary function {name}(t string) returns {kind} return {body}")
