"""Every number that the engine reports, defined once. What was not measured is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import cost, squash
from tessera.operators.ranks import running

#: What the A/B report gives distributions of.
AB = ["b_context_tokens", "c_context_tokens", "compression_ratio", "tokens_saved", "overhead_ms", "b_ttft_ms", "c_ttft_ms", "ttft_delta_ms", "b_total_latency_ms", "c_total_latency_ms", "b_cost", "c_cost", "cost_saved"]
STAGES = ("retrieve", "decompose", "score", "mmr", "select", "assemble")


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median, p95, minimum, maximum of the non-null values; nulls where there are none. p95 is the value at place
    round-half-even(0.95 n + 0.5), from 1. Values are counted first, and places found by running sums over distinct ones, range by
    range, so that no task holds a group's values."""
    c = running(df.select(*by, F.col(value).alias("_x")).groupBy(*by, "_x").agg(F.count("_x").alias("_c")), by, ["_x"], "_to", "_c")
    total = c.groupBy(*by).agg(F.sum("_c").alias("_n")).select(*(F.col(k).alias(f"_of_{k}") for k in by), "_n")
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    c = c.join(total, same).drop(*(f"_of_{k}" for k in by))
    n = F.col("_n")
    at = lambda place: F.min(F.when(F.col("_to") >= place, F.col("_x")))
    median = (at(F.ceil(n / 2)) + at(F.floor(n / 2) + 1)) / 2.0
    p95 = at(F.greatest(F.lit(1), F.least(n, F.rint(0.95 * n + 0.5).cast("long"))))
    g = c.groupBy(*by).agg(F.sum("_c").alias("n"), median.alias("median"), p95.alias("p95"), F.min("_x").alias("minimum"), F.max("_x").alias("maximum"))
    return g.select(*by, "n", *(F.when(F.col("n") > 0, F.col(x)).alias(x) for x in ("median", "p95", "minimum", "maximum")))


def ratio(baseline: Column, compressed: Column) -> Column:
    return 1 - compressed / F.nullif(baseline, F.lit(0))


def overhead(stages: Column) -> Column:
    """The sum of the pipeline's stages, of which missing ones count 0."""
    total = F.lit(0.0)
    for s in STAGES:
        total = total + F.coalesce(F.try_element_at(stages, F.lit(s)), F.lit(0.0))
    return total


def usable_runs(paths: DataFrame) -> DataFrame:
    """One row a run of both paths, and whether a cached prompt contaminates it; runs with an error on either path are left out.
    prompt_tokens (billed by the server) and overhead_ms (of the compression) are null where paths lack them."""
    for c in ("prompt_tokens", "overhead_ms"):
        paths = paths if c in paths.columns else paths.withColumn(c, F.lit(None).cast("double"))
    wide = paths.groupBy("run_id", "query_id").agg(
        *(F.max(F.when(F.col("path") == p, F.col(c))).alias(f"{s}_{c}") for p, s in (("baseline", "b"), ("compressed", "c")) for c in ("context_tokens", "ttft_ms", "total_latency_ms", "completion_tokens", "cached_tokens", "prompt_tokens")),
        F.max(F.when(F.col("path") == "compressed", F.col("overhead_ms"))).alias("overhead_ms"),
        F.count("error").alias("errors"),
        F.countDistinct("path").alias("paths"),
    )
    return wide.where("errors = 0 and paths = 2").withColumn("contaminated", (F.coalesce("b_cached_tokens", F.lit(0)) > 0) | (F.coalesce("c_cached_tokens", F.lit(0)) > 0))


def ab_metrics(runs: DataFrame, price_in: float, price_out: float) -> DataFrame:
    b, c = F.col("b_context_tokens"), F.col("c_context_tokens")
    bill = lambda s, of="context": cost(F.col(f"{s}_{of}_tokens"), F.col(f"{s}_completion_tokens"), price_in, price_out)
    return (
        runs.withColumn("compression_ratio", ratio(b, c))
        .withColumn("tokens_saved", (b - c).cast("double"))
        .withColumn("ttft_delta_ms", F.col("b_ttft_ms") - F.col("c_ttft_ms"))
        .withColumn("output_token_delta", (F.col("b_completion_tokens") - F.col("c_completion_tokens")).cast("double"))
        .withColumn("cost_saved", bill("b") - bill("c"))
        .withColumn("b_cost", bill("b", "prompt"))
        .withColumn("c_cost", bill("c", "prompt"))
        .withColumn("cost_saved_actual", F.col("b_cost") - F.col("c_cost"))
    )


def ab_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """A distribution for each query and metric over clean runs, with the number of runs and of discarded ones."""
    count = runs.groupBy("query_id").agg(F.count_if(~F.col("contaminated")).alias("n_runs"), F.count_if("contaminated").alias("n_discarded"))
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = runs.where("not contaminated").selectExpr("query_id", f"stack({len(metrics)}, {pairs}) as (metric, value)")
    return distribution(long, ["query_id", "metric"], "value").join(count, "query_id")


def verdict(delta: Column) -> Column:
    return F.when(delta > 0, "WINS").when(delta.isNotNull(), "LOSES")


def calibration(samples: DataFrame) -> DataFrame:
    """How a local token count differs from the server's: moments of the difference and its slope in the count."""
    d = (F.col("server_tokens") - F.col("local_tokens")).cast("double")
    x = samples.withColumn("d", d)
    slope = F.coalesce(F.regr_slope("d", "local_tokens"), F.lit(0.0))
    out = x.agg(F.count("*").alias("n"), F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("stdev_delta"), F.min("d").alias("min_delta"), F.max("d").alias("max_delta"), (slope * 1000).alias("slope_per_1k"))
    return out.where("n >= 2").withColumn("exact", (F.abs("slope_per_1k") < 0.5) & (F.col("stdev_delta") < 0.5))


def systematic_sample(df: DataFrame, order: list[str], n: int, total: int) -> DataFrame:
    """Every floor(total / n)-th row in this order, the first n of them: a sampling operator."""
    step = max(1, total // n)
    r = F.col("_place") - 1
    return running(df, [], order, "_place").where((r % step == 0) & (r < step * n)).drop("_place")


def first_token(events: DataFrame) -> DataFrame:
    """Per run and path: milliseconds to the first event with text, to the last event, and between; and the answer."""
    g = events.groupBy("run_id", "path").agg(
        F.min("ts_ms").alias("t0"),
        F.min(F.when(F.coalesce(F.length("delta"), F.lit(0)) > 0, F.col("ts_ms"))).alias("t1"),
        F.max("ts_ms").alias("t2"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("answer"),
    )
    return g.select("run_id", "path", (F.col("t1") - F.col("t0")).alias("ttft_ms"), (F.col("t2") - F.col("t0")).alias("total_latency_ms"), (F.col("t2") - F.col("t1")).alias("stream_ms"), "answer")


def fact_retention(contexts: DataFrame, facts: DataFrame) -> DataFrame:
    """Per query: the share of required facts that its context holds, but for case and white space, and the missing ones."""
    x = facts.join(contexts, "query_id", "left")
    held = F.coalesce(F.contains(squash(F.col("context")), squash(F.col("fact"))), F.lit(False))
    return x.withColumn("held", held).groupBy("query_id").agg(F.avg(F.col("held").cast("double")).alias("fact_retention"), F.array_sort(F.collect_list(F.when(~F.col("held"), F.col("fact")))).alias("missing_facts"))


def llm_wait(ttft: Column, stages: Column) -> Column:
    return F.when(ttft.isNotNull(), F.greatest(F.lit(0.0), ttft - overhead(stages)))
