"""Server-sent events: fields of frames, round trips through files, and streams that go on where they stopped."""

import json

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F
from test_catalog import answer

from tessera import catalog
from tessera.config import Settings
from tessera.operators import chunking
from tessera.plans.compress import compress
from tessera.sources import events


def parsed(spark, *frames):
    return [tuple(r) for r in events.parse(spark.createDataFrame([(f,) for f in frames], "value string")).collect()]


def test_fields_of_frames(spark):
    assert parsed(spark, "event: hit\ndata: {}") == [("hit", None, "{}")]
    assert parsed(spark, "data: a\ndata:b\ndata\ndata:  c\nid: 7") == [("message", "7", "a\nb\n\n c")]
    assert parsed(spark, "event: a\r\nevent: b\r\ndata: x", "﻿data: y", "event:\ndata: z") == [("b", None, "x"), ("message", None, "y"), ("message", None, "z")]
    assert parsed(spark, ": a comment", "event: only", "", None, "retry: 3", "database: no", "\n\ndata: after blank lines") == [("message", None, "after blank lines")]
    assert parsed(spark) == []


ODD = [(1, "plain"), (2, 'quote " and \\ and \n line\r\n\n\nblank lines'), (3, ""), (4, None), (5, "data: x\n\nevent: y"), (6, "é 漢 🙂   \x85"), (7, "long " * 50_000)]


def test_round_trip_of_odd_texts(spark, tmp_path):
    df = spark.createDataFrame(ODD, "n int, t string").repartition(3)
    events.write(df.select(events.frame(F.when(F.col("n") < 4, "low").otherwise("high"), F.struct("n", "t")).alias("frame")), str(tmp_path / "f"))
    back = events.read(spark, str(tmp_path / "f"))
    assert back.count() == len(ODD)
    got = [r for kind in ("low", "high") for r in rows(events.rows(back, kind, "n int, t string"))]
    assert sorted(got, key=lambda r: r[0]) == ODD
    assert rows(events.rows(back, "low", "n int, t int").where("n is not null and t is null").select("n")) == [(1,), (2,), (3,)]


def test_nothing_written_is_nothing_read(spark, tmp_path):
    events.write(spark.createDataFrame([], "frame string"), str(tmp_path / "f"))
    assert events.read(spark, str(tmp_path / "f")).count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("source", "out", "state"))

    def add(*ns):
        df = spark.createDataFrame([(n,) for n in ns], "n int")
        events.write(df.select(events.frame("n", F.struct("n")).alias("frame")).coalesce(1), source, "append")

    def run():
        came = events.rows(events.read(spark, source, stream=True, files_a_batch=1), "n", "n int")
        q = came.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.read.parquet(out))

    add(1, 2)
    add(3)
    assert run() == [(1,), (2,), (3,)]
    assert run() == [(1,), (2,), (3,)]
    add(4)
    assert run() == [(1,), (2,), (3,), (4,)]


@pytest.fixture(scope="module")
def done(spark):
    text = "\n\n".join(f"Paragraph {i} tells of the reservoir, its dam and number {i * 37}.\n- item {i} of a list" for i in range(40))
    docs = spark.createDataFrame([("b", text), ("a", text[:700])], "doc_id string, text string")
    q = spark.createDataFrame([(1, "reservoir number 74"), (2, "zzz"), (3, "")], "query_id long, query string")
    return compress(chunking.chunks(docs), q, Settings(budget=60, top_k=3))


def test_whole_results_as_events(spark, done, tmp_path):
    events.write(events.compression_frames(done), str(tmp_path / "f"))
    got = {x["query_id"]: x for x in (json.loads(r["data"]) for r in events.read(spark, str(tmp_path / "f")).collect())}
    summary, contexts = ({r["query_id"]: r.asDict() for r in df.collect()} for df in (done.summary, done.contexts))
    assert set(got) == {1, 2, 3} == set(summary)
    fields = ["sid", "doc_id", "chunk_id", "char_offset", "text", "tokens", "kind", "relevance", "ce_norm", "bm25_norm", "mmr_score", "similarity", "redundant_with", "selected", "drop_reason"]
    for i, x in got.items():
        assert {k: x[k] for k in summary[i]} == summary[i]
        assert (x["baseline_context"], x["compressed_context"]) == (contexts[i]["baseline_context"], contexts[i]["context"])
        assert all(list(s) == fields for s in x["sentences"])
        order = [(s["doc_id"], s["char_offset"]) for s in x["sentences"]]
        assert order == sorted(order) and len(order) == (summary[i]["n_candidates"] or 0)
        assert sum(s["tokens"] for s in x["sentences"] if s["selected"]) == summary[i]["selected_tokens"]
    assert got[1]["sentences"] and any(s["drop_reason"] for s in got[1]["sentences"])
    assert events.sentence_rows(done).columns == ["query_id", *fields]


def test_frames_from_the_command_line(spark, tmp_path):
    from tessera.__main__ import main

    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.txt").write_text("The dam holds the reservoir back.\n\nAnd the valley lies below it.")
    index, f = str(tmp_path / "i"), str(tmp_path / "f")
    main(["ingest", str(tmp_path / "corpus"), "--index", index, "--min-chunks", "1", "--out", str(tmp_path / "o")], spark)
    for _ in range(2):
        main(["compress", "dam", "valley", "--index", index, "--frames", f, "--out", str(tmp_path / "o")], spark)
    assert [r["event"] for r in events.read(spark, f).collect()] == ["compression"] * 2


def test_query_equals_its_sql(spark):
    got = sorted(repr(tuple(r)) for r in catalog.QUERIES["sse_events"](spark, DATA).collect())
    assert got == answer(DATA, catalog.ORACLE_SQL["sse_events"]) and got
