"""Threshold and greedy token-budget selection, all in expressions: the knapsack is a fold over a query's ordered candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.config import Settings


def density() -> Column:
    """Score per token; negative scores and empty units count 0 and 1."""
    return F.greatest(F.lit(0.0), F.coalesce("mmr_score", "relevance")) / F.greatest(F.lit(1), F.col("token_count"))


def select(candidates: DataFrame, cfg: Settings = Settings(), by: list[str] | None = None) -> DataFrame:
    """candidates (by..., sid, relevance, mmr_score, mmr_rank, token_count, drop_reason and perhaps budget) with selected, drop_type and
    drop_reason.

    The most relevant survivor is taken whatever its size; the others follow by density and are skipped, not final, when they do not
    fit. A null budget is unlimited; without a column budget that of the settings holds.
    """
    by = by or ["query_id"]
    d = candidates if "budget" in candidates.columns else candidates.withColumn("budget", F.lit(cfg.budget).cast("int"))
    low = F.col("drop_reason").isNull() & (F.col("relevance") < cfg.relevance_threshold)
    d = d.withColumn("drop_type", F.when(F.col("drop_reason").isNotNull(), "redundant").when(low, "low relevance"))
    alive = F.col("drop_type").isNull()
    best = F.row_number().over(W.Window.partitionBy(*by).orderBy(F.desc(alive), F.desc("relevance"), "mmr_rank"))
    d = d.withColumn("_best", alive & (best == 1)).withColumn("density", F.round(density(), 12))
    order = F.struct(F.col("_best").cast("int").alias("b"), F.col("density").alias("d"), (-F.col("mmr_rank")).alias("r"), "sid", F.col("token_count").alias("n"))
    per = d.where(alive).groupBy(*by).agg(F.first("budget").alias("_cap"), F.reverse(F.array_sort(F.collect_list(order))).alias("_o"))

    def take(state: Column, x: Column) -> Column:
        fits = (x["b"] == 1) | F.col("_cap").isNull() | (state["used"] + x["n"] <= F.col("_cap"))
        return F.struct(
            F.when(fits, state["used"] + x["n"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["picks"], F.array(x["sid"]))).otherwise(state["picks"]).alias("picks"),
        )

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("picks"))
    picks = per.select(*by, F.explode(F.aggregate("_o", start, take)["picks"]).alias("sid")).withColumn("_p", F.lit(True))
    d = d.join(picks, [*by, "sid"], "left").withColumn("selected", F.coalesce("_p", F.lit(False)))
    kind = F.when(F.col("drop_type").isNotNull(), F.col("drop_type")).when(~F.col("selected"), "over budget")
    text = F.when(kind == "low relevance", F.format_string("low relevance (%.2f)", F.col("relevance"))).otherwise(F.coalesce("drop_reason", kind))
    return d.withColumn("drop_type", kind).withColumn("drop_reason", text).drop("_p", "_best")


def drop_histogram(selected: DataFrame) -> DataFrame:
    """How many candidates each reason dropped."""
    reason = F.when(F.col("drop_reason").startswith("redundant"), "redundant").otherwise(F.substring_index("drop_reason", " (", 1))
    return selected.where("drop_reason is not null").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
