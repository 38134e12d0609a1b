"""Named queries of the engine and DuckDB SQL for each that SQL can express.

Queries are all items of the table benchmark with their whole texts, and a query has Settings.top_k hits. dense_topk searches with
every vector whose id is divisible by 50. Latencies and runs are synthetic, made from the table events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera import sql
from tessera.config import Settings
from tessera.functions.markup import html_to_text
from tessera.functions.splitters import CLOSING, END_BEFORE, NUMBER, OPENING, SPACE, STOP, LearnedSplitter
from tessera.functions.text import FILLER, NEGATIONS, TOKEN, cache_key, cost, rounded, shorten, squash, strip_filler, terms, token_count
from tessera.functions.tokens import RankCounter
from tessera.operators import assemble, boundaries, chunking, encoder, metrics, mmr, retrieval, scoring, selection, vectors
from tessera.plans import compress as plan
from tessera.plans.lineage import bounded, cut, delete, fresh_dir
from tessera.sources import caches, events, files
from tessera.streaming.streams import follow_runs

PRICE_IN, PRICE_OUT = 0.15, 0.6
BLEND = Settings(weight_cross=0.7, weight_bm25=0.3)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def paragraphs(spark, d) -> DataFrame:
    """Documents whose lines are paragraphs."""
    return documents(spark, d).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))


def queries_of(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25_best(spark, d, most: int, zero: bool = False) -> DataFrame:
    q = queries_of(spark, d)
    return plan.searched(documents(spark, d), ["doc_id"], lambda index: index.bm25(q, most, zero=zero))


def _hits(spark, d) -> DataFrame:
    return _bm25_best(spark, d, Settings().top_k).withColumnRenamed("bm25_rank", "hit_rank")


def _candidates(spark, d) -> DataFrame:
    """Lines of each query's best documents, repeats removed."""
    docs = documents(spark, d).join(bounded(_hits(spark, d).select("query_id", "doc_id", "hit_rank")), "doc_id")
    lines = docs.select("query_id", "doc_id", "hit_rank", F.lit(0).alias("chunk_id"), F.posexplode(_lines()).alias("sentence_index", "l"))
    lines = lines.select("query_id", "doc_id", "hit_rank", "chunk_id", "sentence_index", F.col("l.t").alias("text"), F.col("l.o").alias("char_offset"))
    lines = lines.where(F.col("text").rlike(r"[^\s\p{Z}]")).withColumn("token_count", token_count(F.col("text"))).withColumn("kind", F.lit("prose"))
    lines = lines.withColumn("sid", F.concat("doc_id", F.lit("#0."), F.col("sentence_index").cast("string")))
    return chunking.with_order(chunking.exact_dedup(lines, ["query_id"]), ["query_id"])


def _lines():
    """(text, offset) of each line."""
    start = F.struct(F.lit(0).alias("o"), F.array().cast("array<struct<t:string,o:int>>").alias("l"))
    step = lambda s, x: F.struct((s["o"] + F.length(x) + 1).alias("o"), F.concat(s["l"], F.array(F.struct(x.alias("t"), s["o"].alias("o")))).alias("l"))
    return F.aggregate(F.split("text", "\n"), start, step)["l"]


def _scored(spark, d, cfg=Settings()) -> DataFrame:
    return plan.relevance(_candidates(spark, d), queries_of(spark, d), cfg)


def _by_relevance(spark, d) -> DataFrame:
    """Scored candidates in order of relevance, no redundancy considered."""
    w = W.Window.partitionBy("query_id").orderBy(F.desc("relevance"), "cand_idx")
    return _scored(spark, d).withColumn("mmr_rank", F.row_number().over(w)).withColumn("mmr_score", F.lit(None).cast("double")).withColumn("drop_reason", F.lit(None).cast("string"))


TIGHT = Settings(budget=200, relevance_threshold=0.05)


def _chunks(spark, d) -> DataFrame:
    return chunking.chunks(paragraphs(spark, d))


def _compressed(spark, d, cfg=BLEND) -> plan.Compression:
    return plan.compress(cut(_chunks(spark, d)), queries_of(spark, d), cfg)  # in production the index is a written table


def _paths(spark, d) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    odd = i % 2 == 1
    return e.select(
        F.floor(i / 2).alias("run_id"),
        (F.floor(i / 2) % 7).alias("query_id"),
        F.when(odd, "compressed").otherwise("baseline").alias("path"),
        F.when(odd, 200 + i % 300).otherwise(1000 + i % 1000).alias("context_tokens"),
        F.col("value").alias("ttft_ms"),
        (F.col("value") * 2 + 5).alias("total_latency_ms"),
        (i % 97).alias("completion_tokens"),
        F.when(i % 50 == 0, 5).otherwise(0).alias("cached_tokens"),
        F.when(i % 11 > 0, 1500 - i % 700).alias("prompt_tokens"),
        (i % 40 / 4.0).alias("overhead_ms"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )


def _stream(spark, d) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    return e.select(F.floor(i / 20).alias("run_id"), F.lit("compressed").alias("path"), (i % 20).alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(i % 20 < 2, F.lit("")).otherwise(F.concat("event_type", F.lit(" "))).alias("delta"))


LATE_MINUTES, IDLE_MS = 30, 3_600_000


def _run_stream(spark, d) -> DataFrame:
    """The runs that are over by the watermark when all events have been taken as a stream; two of three have an end event."""
    path, folder = f"{d}/events.parquet", fresh_dir(spark, "runs")
    i = F.col("event_id")
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(files.exact_pattern(path))
    e = e.select(F.floor(i / 20).alias("run_id"), F.lit("compressed").alias("path"), (i % 20).alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(i % 20 < 2, "").otherwise(F.concat("event_type", F.lit(" "))).alias("delta"), ((i % 20 == 19) & (F.floor(i / 20) % 3 > 0)).alias("ended"))
    runs = follow_runs(e, f"{LATE_MINUTES} minutes", IDLE_MS)
    q = runs.writeStream.format("parquet").option("path", f"{folder}/runs").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(runs.schema).parquet(f"{folder}/runs")


def _sse_events(spark, d) -> DataFrame:
    """The hits of all queries, out as frames in files and back in by a stream of them."""
    folder, hit = fresh_dir(spark, "events"), "query_id long, doc_id string, hit_rank int"
    events.write(_hits(spark, d).select(events.frame("hit", F.struct("query_id", "doc_id", "hit_rank")).alias("frame")), f"{folder}/frames")
    came = events.rows(events.read(spark, f"{folder}/frames", stream=True), "hit", hit)
    q = came.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(hit).parquet(f"{folder}/rows")


METRICS = [*metrics.AB, "output_token_delta", "cost_saved_actual"]


def _summary(spark, d) -> DataFrame:
    s = metrics.ab_summary(metrics.ab_metrics(metrics.usable_runs(_paths(spark, d)), PRICE_IN, PRICE_OUT), METRICS)
    v = F.when(F.col("metric") == "ttft_delta_ms", metrics.verdict(F.col("median")))
    return s.select("query_id", "metric", "n", *((F.round(c, 9) + 0.0).alias(c) for c in ("median", "p95", "minimum", "maximum")), "n_runs", "n_discarded", v.alias("verdict"))


def _cache(spark, d) -> DataFrame:
    """Hits and misses when the scores of even queries are cached."""
    x = _candidates(spark, d).join(bounded(queries_of(spark, d)), "query_id")
    cache = x.where("query_id % 2 = 0").select(cache_key(F.lit("m"), F.col("query"), F.col("text")).alias("k"), F.lit(0.5).alias("v")).dropDuplicates(["k"])
    return scoring.cache_stats(scoring.probe_cache(x, cache, "m", ["query", "text"])[0])


def _vector_cache(spark, d) -> DataFrame:
    """Hits and misses of each language when a learned encoder's vectors of all English texts are cached before those of all texts
    are asked for."""
    docs, folder = table(spark, d, "documents").select("doc_id", "lang", "text"), fresh_dir(spark, "vector-cache")
    model, cache = encoder.fit(docs.select("doc_id", "text"), ["doc_id"]), caches.vector_cache(spark, folder)
    compute = lambda lacking: model.encode(lacking, ["k"]).withColumnRenamed("embedding", "value")
    cache.through(docs.where("lang = 'en'"), "svd", ["text"], compute)
    found = cut(caches.hit_counts(cache.through(docs, "svd", ["text"], compute), ["lang"]))
    delete(spark, folder)
    return found


def _misses(spark, d) -> DataFrame:
    x = _candidates(spark, d).join(bounded(queries_of(spark, d)), "query_id")
    cache = x.where("query_id % 2 = 0").select(cache_key(F.lit("m"), F.col("query"), F.col("text")).alias("k"), F.lit(0.5).alias("v")).dropDuplicates(["k"])
    return scoring.probe_cache(x, cache, "m", ["query", "text"])[1].select("k", "query")


def _fused(spark, d) -> DataFrame:
    return plan.fused(documents(spark, d), queries_of(spark, d), ["doc_id"])


def _learned(spark, d, most: int) -> DataFrame:
    """The documents nearest to each item, by an encoder learned from all documents."""
    docs, q = documents(spark, d), queries_of(spark, d)
    model = encoder.fit(docs, ["doc_id"])
    found = retrieval.dense_topk(
        model.encode(docs, ["doc_id"]).select(F.col("doc_id").cast("long").alias("vec_id"), "embedding"),
        model.encode(q, ["query_id"], "query").select("query_id", F.col("embedding").alias("qvec")),
        most,
    )
    return cut(found.select("query_id", F.col("vec_id").cast("string").alias("doc_id"), "similarity", "dense_rank"))


def _vector_index_topk(spark, d) -> DataFrame:
    """Exact search by the inverted-file index, for every fiftieth vector."""
    v, folder = table(spark, d, "embeddings").select("vec_id", "embedding"), fresh_dir(spark, "vectors")
    index = vectors.build(v, folder)
    found = cut(index.topk(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), 50, exact=True))
    delete(spark, folder)
    return found


def _filled(text):
    return F.regexp_replace(text, " (the|der|la|que) ", " very ")


def _selected(spark, d) -> DataFrame:
    return selection.select(_by_relevance(spark, d), TIGHT)


def _sql_chunks(spark, d) -> DataFrame:
    sql.register(spark)
    return spark.sql("select d.doc_id, c.* from {docs} d, lateral tessera_chunks(d.text) c", docs=paragraphs(spark, d))


def _sql_units(spark, d) -> DataFrame:
    """Informative units: prose of four tokens or more, or short with a word and a number or name; of other kinds those with a word."""
    sql.register(spark)
    return spark.sql(
        r"""select doc_id, chunk_id, sentence_index, text, char_offset, kind, token_count from (
        select c.doc_id, c.chunk_id, u.sentence_index, u.text, c.char_offset + u.at char_offset, u.kind, u.token_count from {chunks} c, lateral tessera_units(c.text) u)
        where tessera_has_word(text) and (kind <> 'prose' or token_count >= 4 or text rlike r'\p{{Nd}}' or text rlike r'(?s)\S+\s+.*\b[A-Z][a-zA-Z]{{2,}}') or kind = 'prose' and token_count >= 4""",
        chunks=_sql_chunks(spark, d),
    )


def _sql_knapsack(spark, d) -> DataFrame:
    """The candidates that are relevant enough, and which of them the budget takes."""
    sql.register(spark)
    ranked = spark.sql(
        """select query_id, sid, token_count, cast({budget} as int) budget, row_number() over (partition by query_id order by best desc, density desc, mmr_rank) place from (
        select *, row_number() over (partition by query_id order by relevance desc, mmr_rank) = 1 best, round(greatest(0.0d, coalesce(mmr_score, relevance)) / greatest(1, token_count), 12) density
        from {ranked} where drop_reason is null and relevance >= {least})""",
        ranked=_by_relevance(spark, d), least=TIGHT.relevance_threshold, budget=TIGHT.budget,
    )
    return spark.sql("select query_id, sid, token_count, selected from tessera_knapsack(table({ranked}))", ranked=ranked)


def _calibration(spark, d) -> DataFrame:
    x = table(spark, d, "documents").where("text is not null").select(token_count(F.col("text")).alias("local_tokens"), F.col("n_chars").alias("server_tokens"))
    c = metrics.calibration(x)
    return c.select("n", *(F.round(k, 6).alias(k) for k in ("mean_delta", "stdev_delta", "min_delta", "max_delta", "slope_per_1k")), "exact")


def _subwords(spark, d) -> DataFrame:
    """Tokens of every document by the byte-pair vocabulary that the box offers, beside those of the stand-in."""
    import public_tokenizers

    counter = RankCounter.read(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = F.col("text")
    return documents(spark, d).select("doc_id", counter.column(text).alias("n_tokens"), token_count(text).alias("n_approximate"), F.lit(counter.name).alias("token_counter"))


def _sample(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return metrics.systematic_sample(docs.select("doc_id", "lang"), ["doc_id"], 12, docs.count())


QUERIES = {
    "lexical_terms": lambda s, d: documents(s, d).select("doc_id", F.size(terms(F.col("text"))).cast("long").alias("n_terms"), F.size(F.array_distinct(terms(F.col("text")))).cast("long").alias("n_distinct")),
    "bm25_topk": lambda s, d: _bm25_best(s, d, 20).select("query_id", "doc_id", rounded(F.col("bm25_raw"), 6).alias("score"), "bm25_rank"),
    "bm25_zero_pool": lambda s, d: _bm25_best(s, d, 2000, zero=True).select("query_id", "doc_id", rounded(F.col("bm25_raw"), 6).alias("score"), "bm25_rank"),
    "dense_topk": lambda s, d: retrieval.dense_topk(table(s, d, "embeddings").select("vec_id", "embedding"), table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), 50).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "dense_rank"),
    "vector_index_topk": lambda s, d: _vector_index_topk(s, d).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "dense_rank"),
    "encoder_topk": lambda s, d: _learned(s, d, 20).select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), "dense_rank"),
    "encoder_fuse": lambda s, d: plan.fused(documents(s, d), queries_of(s, d), ["doc_id"], dense=_learned(s, d, Settings().pool())).select("query_id", "doc_id", F.round("rrf_score", 9).alias("rrf_score"), "dense_rank", "bm25_rank", "hit_rank"),
    "rrf_fuse": lambda s, d: _fused(s, d).select("query_id", "doc_id", F.round("rrf_score", 9).alias("rrf_score"), "dense_rank", "bm25_rank", "hit_rank"),
    "fusion_census": lambda s, d: retrieval.census(_fused(s, d)),
    "blocks": lambda s, d: chunking.blocks(paragraphs(s, d)),
    "subword_counts": _subwords,
    "chunk_pack": lambda s, d: _chunks(s, d).drop("uid"),
    "ingest_stats": lambda s, d: chunking.ingest_stats(_chunks(s, d)).withColumn("mean_tokens", F.round("mean_tokens", 6)),
    "index_describe": lambda s, d: retrieval.describe(_chunks(s, d)),
    "sentence_units": lambda s, d: chunking.sentence_units(_chunks(s, d)),
    "sentence_ends": lambda s, d: boundaries.learn(documents(s, d)).withColumn("score", F.round("score", 6)),
    "learned_sentence_units": lambda s, d: chunking.sentence_units(_chunks(s, d), Settings(splitter=LearnedSplitter.of(boundaries.learn(documents(s, d))))),
    "exact_dedup": lambda s, d: chunking.exact_dedup(documents(s, d).select("doc_id", F.posexplode(_lines()).alias("sentence_index", "l")).select("doc_id", "sentence_index", F.col("l.t").alias("text"), F.col("l.o").alias("char_offset")), []).select("doc_id", "sentence_index", "char_offset", "text"),
    "query_bm25_minmax": lambda s, d: _scored(s, d).select("query_id", "sid", rounded(F.col("bm25_raw"), 6).alias("bm25_raw"), rounded(F.col("bm25_norm"), 6).alias("bm25_norm"), "cand_idx"),
    "hybrid_score": lambda s, d: _scored(s, d, BLEND).select("query_id", "sid", F.round("ce_raw", 6).alias("ce_raw"), F.round("ce_norm", 6).alias("ce_norm"), F.round("relevance", 6).alias("relevance")),
    "score_cache_stats": _cache,
    "score_cache_misses": _misses,
    "vector_cache_hits": _vector_cache,
    "mmr_greedy": lambda s, d: mmr.mmr(_scored(s, d)).select("query_id", "sid", "mmr_rank", F.round("mmr_score", 6).alias("mmr_score"), "redundant_with", F.round("similarity", 6).alias("similarity"), F.col("drop_reason").isNotNull().alias("dropped")),
    "knapsack": lambda s, d: _selected(s, d).select("query_id", "sid", "token_count", "selected", "drop_type"),
    "drop_histogram": lambda s, d: selection.drop_histogram(_selected(s, d)),
    "strip_filler": lambda s, d: documents(s, d).select("doc_id", strip_filler(_filled(F.col("text"))).alias("text")),
    "assemble_context": lambda s, d: assemble.compressed(assemble.stripped(_selected(s, d).where("selected")), ["query_id"]),
    "baseline_context": lambda s, d: assemble.baseline(documents(s, d).join(bounded(_hits(s, d)), "doc_id")),
    "compression_summary": lambda s, d: _compressed(s, d).summary,
    "compressed_context": lambda s, d: _compressed(s, d, BLEND.but(strip=True)).contexts,
    "budget_sweep": lambda s, d: plan.sweep(_by_relevance(s, d), TIGHT),
    "fact_retention": lambda s, d: metrics.fact_retention(assemble.baseline(documents(s, d).join(bounded(_hits(s, d)), "doc_id")), table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("fact"))),
    "distribution_p95": lambda s, d: metrics.distribution(table(s, d, "events"), ["event_type"], "value").select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("median", "p95", "minimum", "maximum"))),
    "ab_summary": _summary,
    "run_cost": lambda s, d: _paths(s, d).select("run_id", "path", F.round(cost(F.col("context_tokens"), F.col("completion_tokens"), PRICE_IN, PRICE_OUT), 9).alias("usd")),
    "calibration": _calibration,
    "ttft_first_event": lambda s, d: metrics.first_token(_stream(s, d)),
    "run_stream": _run_stream,
    "systematic_sample": _sample,
    "html_text": lambda s, d: table(s, d, "pages").select("page_id", html_to_text("html").alias("text")),
    "sse_frames": lambda s, d: files.sse(_hits(s, d), "hit", ["query_id", "doc_id", "hit_rank"]).select("query_id", "doc_id", "frame"),
    "sse_events": _sse_events,
    "sql_chunks": _sql_chunks,
    "sql_sentence_units": _sql_units,
    "sql_knapsack": _sql_knapsack,
    "query_labels": lambda s, d: table(s, d, "benchmark").select("item_id", shorten(F.col("text"), 46, 43).alias("label"), squash(F.col("text")).alias("norm")),
}

_Q = "q as (select item_id query_id, text query from benchmark)"
_D = "docs as (select doc_id::varchar doc_id, coalesce(text, '') \"text\" from documents)"
_QT = "qt as (select query_id, term, count(*) qtf from (select query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) term from q) group by all)"


def _bm25(name: str, items: str, key: str, scope: str = "") -> str:
    """CTEs that end in name(query_id, key, raw)."""
    by, using = (f"{scope}, ", f"using ({scope}, term)") if scope else ("", "using (term)")
    part = f"partition by {scope}" if scope else ""
    keys = f"{scope}, {key}" if scope else key
    return f"""{name}_t as (select {keys}, regexp_extract_all(lower("text"), '[a-z0-9]+') t from {items}),
{name}_p as (select {keys}, len, term, count(*) tf from (select {keys}, len(t) len, unnest(t) term from {name}_t) group by all),
{name}_n as (select {by}count(*) n, avg(len(t)) avgdl from {name}_t {"group by " + scope if scope else ""}),
{name}_df as (select *, ln(n - df + 0.5) - ln(df + 0.5) idf0 from (select {by}term, count(*) df from {name}_p group by all) {"join" if scope else "cross join"} {name}_n {f"using ({scope})" if scope else ""}),
{name}_i as (select *, case when idf0 < 0 then 0.25 * avg(idf0) over ({part}) else idf0 end idf from {name}_df),
{name} as (select query_id, {key}, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) raw from {name}_p join {name}_i {using} join qt {using} group by query_id, {key})"""


_BASE = f"with {_Q}, {_QT}, {_D}, {_bm25('b', 'docs', 'doc_id')}"
_HITS = f"h as (select * from (select *, row_number() over (partition by query_id order by raw desc, doc_id) hit_rank from b) where hit_rank <= {Settings().top_k})"
_LINES = """l as (select doc_id, i - 1 idx, ls[i] t, (coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0))::int o
from (select doc_id, ls, unnest(range(1, len(ls) + 1)) i from (select doc_id, string_split("text", chr(10)) ls from docs)))"""
_SQUASH = "lower(trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g')))"
_COUNT = "len(regexp_extract_all({0}, '" + TOKEN.replace("{", "{{").replace("}", "}}") + "'))"
_CAND = f"""{_HITS}, {_LINES},
c0 as (select h.query_id, l.doc_id, h.hit_rank, l.idx, l.t, l.o from l join h on l.doc_id = h.doc_id where regexp_matches(l.t, '[^\\s\\p{{Z}}]')),
c1 as (select *, row_number() over (partition by query_id, {_SQUASH.format("t")} order by doc_id, o, hit_rank, idx) f from c0),
c as (select query_id, doc_id, doc_id || '#0.' || idx sid, t as "text", o, idx, {_COUNT.format("t")} tok, row_number() over (partition by query_id order by doc_id, o, idx) cand_idx from c1 where f = 1)"""
_SCORED = f"""{_BASE}, {_CAND}, {_bm25('k', 'c', 'sid', 'query_id')},
s0 as (select c.*, coalesce(k.raw, 0.0) raw from c left join k on c.query_id = k.query_id and c.sid = k.sid),
s1 as (select *, min(raw) over (partition by query_id) lo, max(raw) over (partition by query_id) hi from s0),
s as (select *, case when hi - lo < 1e-12 then 0.0 else (raw - lo) / nullif(hi - lo, 0) end norm from s1)"""
_CHOSEN = f"""{_SCORED},
r as (select *, round(norm, 9) rel, row_number() over (partition by query_id order by round(norm, 9) desc, cand_idx) mmr_rank from s),
v as (select *, round(rel / greatest(1, tok), 12) dens, row_number() over (partition by query_id order by rel desc, mmr_rank) best from r where rel >= {TIGHT.relevance_threshold}),
o as (select query_id, list({{'sid': sid, 'n': tok, 'b': best = 1}} order by (best = 1)::int desc, dens desc, mmr_rank) o from v group by query_id),
rec as (with recursive walk as (select query_id, o, 0::bigint used, 0::bigint i, ''::varchar sid, false took from o union all
select query_id, o, case when o[i + 1].b or used + o[i + 1].n <= {TIGHT.budget} then used + o[i + 1].n else used end, i + 1, o[i + 1].sid, o[i + 1].b or used + o[i + 1].n <= {TIGHT.budget} from walk where i < len(o)) select query_id, sid from walk where i > 0 and took),
z as (select r.*, rec.sid is not null selected, case when rel < {TIGHT.relevance_threshold} then 'low relevance' when rec.sid is null then 'over budget' end drop_type from r left join rec on r.query_id = rec.query_id and r.sid = rec.sid)"""
_FUSED = f"""{_BASE},
lx as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by coalesce(raw, 0) desc, doc_id) bm25_rank from q cross join docs left join b using (query_id, doc_id)) where bm25_rank <= 60),
dn as (select doc_id, sqrt(sum(tf * tf)) norm from b_p group by 1), qn as (select query_id, sqrt(sum(qtf * qtf)) qnorm from qt group by 1),
co as (select query_id, doc_id, round(sum(tf * qtf) / (any_value(norm) * any_value(qnorm)), 9) sim from b_p join qt using (term) join dn using (doc_id) join qn using (query_id) group by 1, 2),
de as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by sim desc, doc_id) dense_rank from co) where dense_rank <= 60),
fu as (select coalesce(de.query_id, lx.query_id) query_id, coalesce(de.doc_id, lx.doc_id) doc_id, dense_rank, bm25_rank, round(coalesce(1.0::double / (60 + dense_rank), 0) + coalesce(1.0::double / (60 + bm25_rank), 0), 12) rrf from de full join lx on de.query_id = lx.query_id and de.doc_id = lx.doc_id),
fh as (select * from (select *, row_number() over (partition by query_id order by rrf desc, dense_rank nulls last, bm25_rank nulls last, doc_id) hit_rank from fu) where hit_rank <= 20)"""
_P95 = "case when count({0}) > 0 then list_sort(list({0}) filter ({0} is not null))[greatest(1, least(count({0}), round_even(0.95 * count({0}) + 0.5, 0)::int))] end"
_PATHS = "p as (select event_id // 2 run_id, (event_id // 2) % 7 query_id, case when event_id % 2 = 1 then 'compressed' else 'baseline' end path, case when event_id % 2 = 1 then 200 + event_id % 300 else 1000 + event_id % 1000 end context_tokens, value ttft_ms, event_id % 97 completion_tokens, case when event_id % 50 = 0 then 5 else 0 end cached, value * 2 + 5 total_latency_ms, case when event_id % 11 > 0 then 1500 - event_id % 700 end prompt_tokens, case when event_id % 2 = 1 then (event_id % 40) / 4.0 end overhead, case when event_type = 'error' then 'failed' end error from events)"
_FILLED = "regexp_replace(coalesce(text, ''), ' (the|der|la|que) ', ' very ', 'g')"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_GUARD = lambda i: f"coalesce(regexp_matches(w[{i}], '\\p{{Nd}}') or lower(w[{i}]) in {_IN(NEGATIONS)}, false)"

def bm25_sql() -> str:
    """CTEs q, docs and b(query_id, doc_id, raw): every item's scores of all documents."""
    return _BASE


def squash_sql(text: str) -> str:
    return _SQUASH.format(text)


def count_sql(text: str) -> str:
    return _COUNT.format(text)


def chunks_sql(docs: str, cfg: Settings = Settings()) -> str:
    """CTEs that end in chunks(doc_id, chunk_id, char_offset, text, token_count), for documents whose lines are paragraphs. cb are the
    blocks; cd has a document's block sizes and their running sums; cw walks the blocks: w is the first block of the open chunk when
    block i comes, and a full chunk's successor starts with the last blocks that hold the overlap."""
    target, want = cfg.chunk_tokens, int(cfg.chunk_tokens * cfg.overlap)
    return f"""with recursive docs as ({docs}), {_LINES},
cb as (select doc_id, (row_number() over (partition by doc_id order by idx) - 1)::int i, (o + idx)::int o, regexp_replace(t, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') t, {_COUNT.format('t')}::int n from l where regexp_matches(t, '[^\\s\\p{{Z}}]')),
cs as (select doc_id, i, n, coalesce(sum(n) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::int s from cb),
cd as (select doc_id, list(n order by i) n, list(s order by i) s from cs group by 1),
cw as (select doc_id, 0 i, 0 w from cd union all
select doc_id, i + 1, case when n[i + 1] >= {target} then i + 1 when w < i and s[i + 1] - s[w + 1] + n[i + 1] > {target} then greatest(w, len(list_filter(s[1:i + 1], lambda x: x <= s[i + 1] - {want})) - 1) else w end from cw join cd using (doc_id) where i < len(n)),
ce as (select doc_id, w a, i z from cw join cd using (doc_id) where w < i and (i = len(n) or n[i + 1] >= {target} or s[i + 1] - s[w + 1] + n[i + 1] > {target})
union all select doc_id, i, i + 1 from cw join cd using (doc_id) where n[i + 1] >= {target}),
cf as (select doc_id, (row_number() over (partition by doc_id order by z) - 1)::int chunk_id, a, z from ce),
cg as (select doc_id, chunk_id, min(o) char_offset, string_agg(t, chr(10) || chr(10) order by i) as "text" from cf join cb using (doc_id) where i >= a and i < z group by 1, 2),
chunks as (select *, {_COUNT.format('"text"')}::int token_count from cg)"""


_ALL_CHUNKS = chunks_sql("select doc_id::varchar doc_id, coalesce(text, '') \"text\" from documents")



def _like(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def ends_sql(docs: str, least: int = 5) -> str:
    """boundaries.learn in SQL, for documents docs."""
    bare = lambda x: f"regexp_replace(regexp_replace({x}, {_like(CLOSING)}, ''), {_like(OPENING)}, '')"
    kind = lambda x: f"case when regexp_matches({bare(x)}, {_like(NUMBER)}) then '0' when regexp_matches({bare(x)}, '\\p{{L}}') then lower({bare(x)}) end"
    ll = lambda k, n, p: f"(case when {k} > 0 then ({k}) * ln(case when {k} > 0 then {p} else 1 end) else 0 end + case when {n} > {k} then ({n} - ({k})) * ln(case when {n} > {k} then 1 - {p} else 1 end) else 0 end)"
    tie = lambda a, b, c, n: f"2 * ({ll(c, a, f'(({c})::double / ({a}))')} + {ll(f'({b} - {c})', f'({n} - {a})', f'(({b} - {c})::double / nullif({n} - {a}, 0))')} - {ll(c, a, f'(({b})::double / ({n}))')} - {ll(f'({b} - {c})', f'({n} - {a})', f'(({b})::double / ({n}))')})"
    length = "greatest(length(replace(w, '.', '')), 1)"
    return f"""with docs as ({docs}), lines as (select unnest(string_split("text", chr(10))) line from docs),
lw as (select list_filter(regexp_split_to_array(line, {_like(SPACE)}), lambda x: x <> '') l from lines),
bw as (select unnest(list_zip(list_concat([null], l)[1:len(l)], l)) x from lw where len(l) > 0),
wd as (select before, word, {kind('before')} p, {kind('word')} w from (select x[1] before, x[2] word from bw)),
ty as (select w, count(*) n, count(*) filter (regexp_matches(word, {_like(STOP)})) n_stop, count(*) filter (regexp_matches(regexp_replace(word, {_like(OPENING)}, ''), '^\\p{{Ll}}')) n_lower, count(*) filter (before is not null and not regexp_matches(before, {_like(END_BEFORE)}) and regexp_matches(word, '^\\p{{Lu}}')) n_upper from wd where w is not null group by 1),
tt as (select sum(n)::bigint n_all, least(greatest(sum(n_stop)::double / sum(n), 1e-12), 1 - 1e-12) rate from ty),
sc as (select w, n_stop, 2 * ({ll('n_stop', 'n', '0.99::double')} - {ll('n_stop', 'n', 'rate')}) * exp(-{length}) * (1 + length(w) - length(replace(w, '.', ''))) * pow({length}::double, n_stop - n) score from ty, tt where n >= {least} and n_stop > 0 and w <> '0'),
ab as (select * from sc where score >= 0.3),
pa as (select p, w, count(*) n_pair from wd where regexp_matches(before, {_like(STOP)}) and regexp_matches(regexp_replace(word, {_like(OPENING)}, ''), '^[\\p{{Lu}}0-9]') and p is not null and w is not null group by 1, 2),
ar as (select p, w, n_pair, (p in (select w from ab) or p = '0' or length(p) = 1) special from pa),
br as (select sum(n_pair)::bigint n_break from ar where not special),
st as (select w, after, {tie('n_break', 'n', 'after', 'n_all')} score from (select w, sum(n_pair)::bigint after from ar where not special group by 1) join ty using (w), br, tt where after >= {least} and after * n_all::double > n * n_break::double),
sr as (select * from st where score >= 30),
co as (select p, w, n_pair, {tie('s.n_stop', 't.n', 'n_pair', 'n_all')} score from ar join ty t using (w) join (select w p, n_stop from ty) s using (p), tt where special and n_pair >= {least} and n_pair * n_all::double > s.n_stop * t.n::double and w not in (select w from sr)),
ca as (select w, n_lower, n_upper from (select w, sum(n_pair) after from ar where special group by 1) join ty using (w) where after >= {least} and w <> '0')
select 'abbreviation' kind, w word, null::varchar "next", n_stop n, round(score, 6) score from ab
union all select 'starter', w, null, after, round(score, 6) from sr union all select 'collocation', p, w, n_pair, round(score, 6) from co where score >= 7.88
union all select 'common', w, null, n_lower, null from ca where n_lower > 0 and n_upper * 10 <= n_lower union all select 'proper', w, null, n_upper, null from ca where n_upper > 0 and n_lower * 10 <= n_upper"""


ORACLE_SQL = {
    "sentence_ends": ends_sql("select coalesce(text, '') \"text\" from documents"),
    "chunk_pack": f"{_ALL_CHUNKS} select * from chunks",
    "sql_chunks": f"{_ALL_CHUNKS} select * from chunks",
    "ingest_stats": f"{_ALL_CHUNKS} select count(*) n_chunks, coalesce(sum(token_count), 0)::bigint total_tokens, round(avg(token_count), 6) mean_tokens from chunks",
    "index_describe": f"{_ALL_CHUNKS} select count(*) n_chunks, count(distinct doc_id) n_documents from chunks",
    "lexical_terms": f"with {_D} select doc_id, len(t)::bigint n_terms, len(list_distinct(t))::bigint n_distinct from (select doc_id, regexp_extract_all(lower(\"text\"), '[a-z0-9]+') t from docs)",
    "bm25_topk": f"{_BASE} select query_id, doc_id, round(raw, 6) score, r::int bm25_rank from (select *, row_number() over (partition by query_id order by raw desc, doc_id) r from b) where r <= 20",
    "bm25_zero_pool": f"{_BASE} select query_id, doc_id, round(raw, 6) score, r::int bm25_rank from (select query_id, doc_id, coalesce(raw, 0.0) raw, row_number() over (partition by query_id order by coalesce(raw, 0.0) desc, doc_id) r from q cross join docs left join b using (query_id, doc_id)) where r <= 2000",
    "dense_topk": "select query_id, vec_id, round(sim, 6) similarity, r::int dense_rank from (select *, row_number() over (partition by query_id order by sim desc, vec_id) r from (select a.vec_id query_id, b.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) sim from embeddings a cross join embeddings b where a.vec_id % 50 = 0)) where r <= 50",
    "vector_index_topk": "select query_id, vec_id, round(sim, 6) similarity, r::int dense_rank from (select *, row_number() over (partition by query_id order by sim desc, vec_id) r from (select a.vec_id query_id, b.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) sim from embeddings a cross join embeddings b where a.vec_id % 50 = 0)) where r <= 50",
    "rrf_fuse": f"{_FUSED} select query_id, doc_id, round(rrf, 9) rrf_score, dense_rank::int dense_rank, bm25_rank::int bm25_rank, hit_rank::int hit_rank from fh",
    "fusion_census": f"{_FUSED} select query_id, count(*) filter (dense_rank is not null and bm25_rank is not null) n_both, count(*) filter (bm25_rank is null) n_dense_only, count(*) filter (dense_rank is null) n_bm25_only from fh group by 1",
    "blocks": f"with {_D}, {_LINES} select doc_id, (row_number() over (partition by doc_id order by idx) - 1)::int block_id, (o + idx)::int char_offset, regexp_replace(t, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as \"text\", false is_table, {_COUNT.format('t')}::int token_count from l where regexp_matches(t, '[^\\s\\p{{Z}}]')",
    "exact_dedup": f"with {_D}, {_LINES} select doc_id, idx::int sentence_index, o char_offset, t as \"text\" from (select *, row_number() over (partition by {_SQUASH.format('t')} order by doc_id, o, idx) r from l) where r = 1",
    "query_bm25_minmax": f"{_SCORED} select query_id, sid, round(raw, 6) bm25_raw, round(norm, 6) bm25_norm, cand_idx::int cand_idx from s",
    "hybrid_score": f"""{_SCORED}, x as (select s.*, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) a, list_distinct(regexp_extract_all(lower("text"), '[a-z0-9]+')) b from s join q using (query_id)),
y as (select *, case when len(a) > 0 and len(b) > 0 then 8.0::double * len(list_intersect(a, b)) / sqrt(len(a)::double * len(b)) + 4.0::double * len(list_intersect(a, b)) / len(a) - 4.0 end ce from x),
n as (select *, coalesce(1 / (1 + exp(-ce)), 0.0) cn from y) select query_id, sid, round(ce, 6) ce_raw, round(cn, 6) ce_norm, round(round(0.7::double * cn + 0.3::double * norm, 9), 6) relevance from n""",
    "score_cache_stats": f"{_BASE}, {_CAND}, k as (select query_id, sha256('m' || chr(0) || query || chr(0) || \"text\" || chr(0)) k from c join q using (query_id)) select query_id, count(*) filter (k in (select k from k where query_id % 2 = 0)) hits, count(*) filter (k not in (select k from k where query_id % 2 = 0)) misses from k group by 1",
    "score_cache_misses": f"{_BASE}, {_CAND}, k as (select query_id, query, 's:' || sha256('m' || chr(0) || query || chr(0) || \"text\" || chr(0)) k from c join q using (query_id)) select distinct k, query from k where k not in (select k from k where query_id % 2 = 0)",
    "vector_cache_hits": "select lang, count(*) filter (text in (select text from documents where lang = 'en' and text is not null)) hits, count(*) filter (text not in (select text from documents where lang = 'en' and text is not null)) misses from documents group by 1",
    "sql_knapsack": f"{_CHOSEN} select query_id, sid, tok::int token_count, selected from z where drop_type is null or drop_type = 'over budget'",
    "knapsack": f"{_CHOSEN} select query_id, sid, tok::int token_count, selected, drop_type from z",
    "drop_histogram": f"{_CHOSEN} select drop_type reason, count(*) n from z where drop_type is not null group by 1",
    "strip_filler": f"""with a as (select doc_id::varchar doc_id, {_FILLED} as "text" from documents), b as (select *, regexp_extract_all("text", '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') w from a),
g as (select *, list_filter(range(1, len(w) + 1), lambda i: lower(w[i]) in {_IN(FILLER)} and not (i > 2 and {_GUARD('i - 2')}) and not {_GUARD('i + 2')}) gone from b)
select doc_id, case when len(gone) = 0 then "text" else regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]), ''), '[\\s\\p{{Z}}]{{2,}}', ' ', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') end as "text" from g""",
    "assemble_context": f"""{_CHOSEN}, e as (select *, o > lag(o + length("text")) over w gap, row_number() over w n from z where selected window w as (partition by query_id, doc_id order by o, mmr_rank)),
f as (select query_id, doc_id, '[SOURCE: ' || doc_id || ']' || chr(10) || string_agg(case when gap then '[...]' || chr(10) || "text" else "text" end, chr(10) order by n) t from e group by 1, 2) select query_id, string_agg(t, chr(10) || chr(10) order by doc_id) context from f group by 1""",
    "baseline_context": f"{_BASE}, {_HITS} select query_id, string_agg('[SOURCE: ' || doc_id || ']' || chr(10) || \"text\", chr(10) || chr(10) order by hit_rank) context from h join docs using (doc_id) group by 1",
    "fact_retention": f"""{_BASE}, {_HITS}, x as (select query_id, string_agg('[SOURCE: ' || doc_id || ']' || chr(10) || "text", chr(10) || chr(10) order by hit_rank) context from h join docs using (doc_id) group by 1),
f as (select item_id query_id, text fact from benchmark), y as (select query_id, fact, coalesce(contains({_SQUASH.format('context')}, {_SQUASH.format('fact')}), false) held from f left join x using (query_id))
select query_id, avg(held::int::double) fact_retention, coalesce(list_sort(list(fact) filter (not held)), []) missing_facts from y group by 1""",
    "distribution_p95": f"select event_type, count(value) n, round(median(value), 6) median, round({_P95.format('value')}, 6) p95, round(min(value), 6) minimum, round(max(value), 6) maximum from events group by 1",
    "ab_summary": f"""with {_PATHS}, r as (select run_id, query_id, {', '.join(f"max({c}) filter (path = '{n}') {s}_{c}" for n, s in (('baseline', 'b'), ('compressed', 'c')) for c in ('context_tokens', 'ttft_ms', 'completion_tokens', 'cached', 'total_latency_ms', 'prompt_tokens'))}, max(overhead) overhead_ms from p group by 1, 2 having count(error) = 0 and count(distinct path) = 2),
m as (select *, b_cached > 0 or c_cached > 0 bad, 1 - c_context_tokens / b_context_tokens::double compression_ratio, (b_context_tokens - c_context_tokens)::double tokens_saved, b_ttft_ms - c_ttft_ms ttft_delta_ms, (b_completion_tokens - c_completion_tokens)::double output_token_delta, (b_context_tokens * {PRICE_IN} + b_completion_tokens * {PRICE_OUT})::double / 1e6 - (c_context_tokens * {PRICE_IN} + c_completion_tokens * {PRICE_OUT})::double / 1e6 cost_saved, (b_prompt_tokens * {PRICE_IN}::double + b_completion_tokens * {PRICE_OUT}::double) / 1e6 b_cost, (c_prompt_tokens * {PRICE_IN}::double + c_completion_tokens * {PRICE_OUT}::double) / 1e6 c_cost, (b_prompt_tokens * {PRICE_IN}::double + b_completion_tokens * {PRICE_OUT}::double) / 1e6 - (c_prompt_tokens * {PRICE_IN}::double + c_completion_tokens * {PRICE_OUT}::double) / 1e6 cost_saved_actual from r),
u as (unpivot (select query_id, {', '.join(f'{c}::double {c}' for c in METRICS)} from m where not bad) on {', '.join(METRICS)} into name metric value v),
g as (select query_id, count(*) filter (not bad) n_runs, count(*) filter (bad) n_discarded from m group by 1),
d as (select query_id, metric, count(v) n, median(v) md, {_P95.format('v')} p95, min(v) mi, max(v) ma from u group by 1, 2)
select query_id, metric, n, round(md, 9) + 0.0 median, round(p95, 9) + 0.0 p95, round(mi, 9) + 0.0 minimum, round(ma, 9) + 0.0 maximum, n_runs, n_discarded, case when metric = 'ttft_delta_ms' then case when md > 0 then 'WINS' else 'LOSES' end end verdict from d join g using (query_id)""",
    "run_cost": f"with {_PATHS} select run_id, path, round((context_tokens * {PRICE_IN}::double + completion_tokens * {PRICE_OUT}::double) / 1e6, 9) usd from p",
    "calibration": f"""with x as (select {_COUNT.format('text')} l, n_chars - {_COUNT.format('text')} d from documents where text is not null), a as (select count(*) n, avg(d) m, stddev_samp(d) s, min(d)::double mi, max(d)::double ma, coalesce(regr_slope(d, l), 0) * 1000 k from x)
select n, round(m, 6) mean_delta, round(s, 6) stdev_delta, mi min_delta, ma max_delta, round(k, 6) slope_per_1k, abs(k) < 0.5 and s < 0.5 exact from a where n >= 2""",
    "ttft_first_event": """with e as (select event_id // 20 run_id, event_id % 20 seq, epoch_us(ts) // 1000 ts, case when event_id % 20 < 2 then '' else event_type || ' ' end delta from events)
select run_id, 'compressed' path, min(ts) filter (delta <> '') - min(ts) ttft_ms, max(ts) - min(ts) total_latency_ms, max(ts) - min(ts) filter (delta <> '') stream_ms, string_agg(delta, '' order by seq) answer from e group by 1""",
    "run_stream": f"""with e as (select event_id // 20 run_id, event_id % 20 seq, epoch_us(ts) // 1000 ms, case when event_id % 20 < 2 then '' else event_type || ' ' end delta, event_id % 20 = 19 and (event_id // 20) % 3 > 0 e from events),
g as (select run_id, 'compressed' path, min(ms) filter (delta <> '') - min(ms) ttft_ms, max(ms) - min(ms) total_latency_ms, max(ms) - min(ms) filter (delta <> '') stream_ms, string_agg(delta, '' order by seq) answer, bool_or(e) ended, max(ms) z from e group by 1)
select * exclude z from g where z + case when ended then 1 else {IDLE_MS + 1} end < (select max(ms) from e) - {LATE_MINUTES * 60_000}""",
    "systematic_sample": "select doc_id, lang from (select doc_id, lang, row_number() over (order by doc_id) - 1 r, greatest(1, count(*) over () // 12) s from documents) where r % s = 0 and r < s * 12",
    "sse_events": f"{_BASE}, {_HITS} select query_id, doc_id, hit_rank::int hit_rank from h",
    "sse_frames": f"{_BASE}, {_HITS} select query_id, doc_id, 'event: hit' || chr(10) || 'data: {{\"query_id\":' || query_id || ',\"doc_id\":\"' || doc_id || '\",\"hit_rank\":' || hit_rank || '}}' || chr(10) || chr(10) frame from h",
    "query_labels": f"select item_id, case when length(text) >= 46 then left(text, 43) || '...' else text end as \"label\", {_SQUASH.format('text')} norm from benchmark",
}
