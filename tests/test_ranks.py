"""Places in an order against a sorted list."""

import random

from conftest import rows

from tessera.operators import metrics, ranks


def test_running_sums_of_groups(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.randint(0, 3), i) for i in range(400)]
    d = spark.createDataFrame(data, "g string, x int, w int, `a.b` int").repartition(7)
    got = ranks.running(d, ["g"], ["x", "a.b"], "to", "w")
    assert got.columns == ["g", "x", "w", "a.b", "to"]
    want, sums = [], {}
    for g, x, w, i in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
        sums[g] = sums.get(g, 0) + w
        want.append((g, x, w, i, sums[g]))
    assert rows(got) == sorted(want, key=repr)


def test_places_without_gaps_and_equal_rows(spark):
    d = spark.createDataFrame([(1,)] * 30 + [(2,)] * 5 + [(None,)], "x int").repartition(5)
    got = sorted((r["p"], r["x"]) for r in ranks.running(d, [], ["x"], "p").collect())
    assert [p for p, _ in got] == list(range(1, 37)) and [x for _, x in got] == [None, *[1] * 30, *[2] * 5]
    assert rows(ranks.running(d.limit(0), [], ["x"], "p")) == []


def test_no_task_holds_a_group(spark):
    d = spark.range(4000).selectExpr("'one' g", "rand(3) x").cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts ranges as small as these together
    try:
        cells = [r["count"] for r in ranks.running(d, ["g"], ["x"], "p").selectExpr("spark_partition_id() k").groupBy("k").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(cells) == 4000 and max(cells) < 3500
    values = sorted(r["x"] for r in d.collect())
    got = metrics.distribution(d, ["g"], "x").first()
    assert (got["n"], got["median"], got["p95"]) == (4000, (values[1999] + values[2000]) / 2, values[round(0.95 * 4000 + 0.5) - 1])


def test_sample_takes_every_step(spark):
    d = spark.range(1000).repartition(6)
    assert [r["id"] for r in metrics.systematic_sample(d, ["id"], 12, 1000).orderBy("id").collect()] == [83 * i for i in range(12)]
