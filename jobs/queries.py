"""The jobs as queries over whole tables, each run twice into one new folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import ingest_stream, retention_report
from tessera.catalog import bm25_sql, chunks_sql, count_sql, squash_sql
from tessera.plans.lineage import fresh_dir

INGEST = ingest_stream.Config(line_paragraphs=True)
REPORT = retention_report.Config()


def job1_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "job1")
    for _ in range(2):
        ingest_stream.ingest(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/state", INGEST)
    return ingest_stream.current(spark, f"{folder}/out").drop("batch")


def job2_retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "job2")
    for _ in range(2):
        retention_report.report(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/out", REPORT)
    return retention_report.read(spark, f"{folder}/out")


QUERIES = {"job1_ingest_stream": job1_ingest_stream, "job2_retention_report": job2_retention_report}

ORACLE_SQL = {
    "job1_ingest_stream": chunks_sql("select doc_id::varchar doc_id, coalesce(max(text), '') \"text\" from documents where doc_id is not null group by doc_id") + " select doc_id, chunk_id, char_offset, \"text\", token_count from chunks",
    "job2_retention_report": f"""{bm25_sql()},
h as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by raw desc, doc_id) rank from b) where rank <= {max(REPORT.depths)}),
x as (select query_id, rank, {count_sql('docs."text"')} tokens, contains({squash_sql('docs."text"')}, {squash_sql('query')}) held from h join docs using (doc_id) join q using (query_id)),
e as (select query_id, unnest([{", ".join(map(str, REPORT.depths))}]) depth from q),
s as (select e.query_id, depth, count(rank) n_hits, coalesce(sum(tokens), 0)::bigint context_tokens, min(rank) filter (held) first_rank from e left join x on e.query_id = x.query_id and rank <= depth group by all)
select query_id, n_hits, context_tokens, round(context_tokens * {REPORT.price_per_million}::double / 1e6, 9) usd, first_rank::int first_rank, first_rank is not null retained, depth::int depth from s""",
}
