"""The stages as SQL functions: equal to the DataFrame functions and to plain loops."""

import random

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F
from test_catalog import answer

from tessera import catalog, sql
from tessera.config import Settings
from tessera.functions import text as t
from tessera.functions.text import TOKEN
from tessera.operators import chunking

TEXTS = [None, "", " \n\n ", "One ends. Two too.\n\n- item 1\n- item 2", "[TABLE]\na | b\n[/TABLE]\n\nAfter it.", "Ärzte gehen. É 漢字 🙂!", "x " * 3000 + "\n\n" + "Y ends. " * 300]


@pytest.fixture()
def docs(spark):
    sql.register(spark)
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(TEXTS)], "doc_id string, text string")


def test_scalar_functions(spark, docs):
    got = spark.sql("select doc_id, tessera_terms(text), tessera_tokens(text), tessera_squash(text), tessera_has_word(text) from {docs}", docs=docs)
    x = F.col("text")
    assert rows(got) == rows(docs.select("doc_id", t.terms(x), t.token_count(x), t.squash(x), t.has_word(x)))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and TOKEN in sql.SCALAR["tessera_tokens"][1]


@pytest.mark.parametrize("cfg", [Settings(), Settings(chunk_tokens=60, overlap=0.3)])
def test_chunks_and_units(spark, docs, cfg):
    sql.register(spark, cfg)
    want = chunking.chunks(docs, cfg).select("doc_id", "chunk_id", "char_offset", "text", "token_count")
    got = spark.sql("select d.doc_id, c.* from {docs} d, lateral tessera_chunks(d.text) c", docs=docs)
    assert rows(got) == rows(want) and {r["doc_id"] for r in got.collect()} == {"3", "4", "5", "6"}
    units = spark.sql("select c.doc_id, c.chunk_id, u.sentence_index, u.text, u.kind, u.token_count from {c} c, lateral tessera_units(c.text) u", c=got)
    some = chunking.sentence_units(want, cfg).select("doc_id", "chunk_id", "sentence_index", "text", "kind", "token_count")
    assert set(rows(some)) <= set(rows(units)) and units.count() > 0


def test_knapsack_against_a_loop(spark):
    sql.register(spark)
    rng = random.Random(11)
    cands = [(q, place, rng.choice([None, 0, *range(1, 80)]), None if q % 7 == 0 else 40 + q, f"{q}.{place}", "x y") for q in range(60) for place in rng.sample(range(1000), rng.randrange(0, 30))]
    df = spark.createDataFrame(cands, "query_id int, place int, token_count int, budget int, sid string, `odd.name` string").repartition(5)
    got = spark.sql("select * from tessera_knapsack(table({c}))", c=df)
    assert got.columns == [*df.columns, "selected"]
    want = set()
    for q in range(60):
        used = None
        for _, _, n, cap, sid, _ in sorted(c for c in cands if c[0] == q):
            if used is None or cap is None or used + (n or 0) <= cap:
                used = (used or 0) + (n or 0)
                want.add(sid)
    assert {r["sid"] for r in got.collect() if r["selected"]} == want and got.count() == len(cands)
    assert spark.sql("select * from tessera_knapsack(table({c}))", c=df.where("false")).count() == 0


def test_knapsack_says_what_is_wrong(spark):
    sql.register(spark)
    for df, why in ((spark.range(1), "lacks query_id, place"), (spark.sql("select 1 query_id, 1 place, 1 token_count, 1 budget, true selected"), "column selected")):
        with pytest.raises(Exception, match=why):
            spark.sql("select * from tessera_knapsack(table({c}))", c=df)


@pytest.mark.parametrize("name", ["sql_chunks", "sql_knapsack"])
def test_queries_equal_their_sql(spark, name):
    got = sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, DATA).collect())
    assert got == answer(DATA, catalog.ORACLE_SQL[name]) and got


def test_units_query_equals_the_dataframe(spark):
    got = catalog.QUERIES["sql_sentence_units"](spark, DATA)
    assert rows(got) == rows(catalog.QUERIES["sentence_units"](spark, DATA).select(*got.columns)) and got.count()
