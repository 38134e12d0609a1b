"""Places in an order, of groups of any size: no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.plans.lineage import cut


def running(df: DataFrame, by: list[str], order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """df with out: the sum of weight (by default 1) over the rows of the same `by` up to this one, in ascending order, nulls first.
    Rows that agree in `order` follow each other by a hash of all columns; equal rows are interchangeable.

    The rows are dealt into ranges of (by, order), the ranges of each group added up, and each is sorted by itself: what one task sees
    is a range, or as many equal rows as there are. A range is known by the partition that holds it, so it is cut before it is read.
    """
    tie = [F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))] if df.columns else []
    keys = [*(F.col(f"`{c}`") for c in [*by, *order]), *tie]
    dealt = cut(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).withColumn("_tie", *tie))
    one = F.lit(1) if weight is None else F.col(weight)
    group = [f"`{c}`" for c in by]
    sums = dealt.groupBy(*group, "_range").agg(F.sum(one).alias("_sum"))
    before = W.Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)  # a row a range
    start = sums.select(*group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = W.Window.partitionBy(*group, "_range").orderBy(*(f"`{c}`" for c in order), "_tie").rowsBetween(W.Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_in", F.sum(one).over(inside)).alias("l")
    same = F.col("l._range") == F.col("r._range")
    for c in group:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = placed.join(start.alias("r"), same)
    return joined.select(*(F.col(f"l.`{c}`") for c in df.columns), (F.col("r._start") + F.col("l._in")).cast("long").alias(out))
