"""The jobs: runs over growing input, runs again, failures in between, odd rows, and the command line."""

import json
import os
import subprocess
import sys

import pytest
from conftest import DATA, ROOT, rows

from jobs import ingest_stream, retention_report
from jobs import queries as jobs
from jobs.common import configured

DOCS = "doc_id long, text string, batch string, bucket int"
SMALL = ingest_stream.Config(chunk_tokens=8, overlap=0.25, line_paragraphs=True, files_per_batch=1)


def add(spark, folder, docs):
    spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).coalesce(1).write.mode("append").parquet(folder)


def shown(spark, out):
    got = {}
    for r in ingest_stream.current(spark, out).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["batch"]))
    return got


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    add(spark, src, [(1, "one two three"), (2, "a b c d\ne f g h\ni j"), (3, None), (None, "nameless"), (4, "old text")])
    first = ingest_stream.ingest(spark, src, out, state, SMALL)
    assert [(d["rows_read"], d["documents"], d["rows_without_id"]) for d in first] == [(5, 4, 1)]
    before = rows(ingest_stream.current(spark, out))
    assert ingest_stream.ingest(spark, src, out, state, SMALL) == []  # nothing new
    assert rows(ingest_stream.current(spark, out)) == before

    add(spark, src, [(5, "five"), (4, "new text"), (4, "a lesser text"), (2, "")])
    second = ingest_stream.ingest(spark, src, out, state, SMALL)
    assert [(d["batch"], d["rows_read"], d["documents"]) for d in second] == [(1, 4, 3)]
    # 4 has its new text, the greatest of two; 2 has none; 1 is as it was
    assert shown(spark, out) == {"1": [("one two three", 0)], "4": [("new text", 1)], "5": [("five", 1)]}


def test_ingest_in_two_steps_equals_one(spark, tmp_path):
    docs = [(i, "\n".join(f"word{j} " * (j % 5 + 1) for j in range(i % 9))) for i in range(40)]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in (docs[:15], docs[15:]):
        add(spark, src, part)
        ingest_stream.ingest(spark, src, out, state, SMALL)
    whole = str(tmp_path / "whole")
    add(spark, whole, docs)
    ingest_stream.ingest(spark, whole, str(tmp_path / "out2"), str(tmp_path / "state2"), SMALL)
    once, twice = (rows(ingest_stream.current(spark, str(tmp_path / x)).drop("batch")) for x in ("out2", "out"))
    assert once == twice and once


def test_batch_that_failed_is_replaced(spark, tmp_path, monkeypatch):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    add(spark, src, [(1, "one"), (2, "two")])
    put = ingest_stream._put

    def broken(df, folder):
        if folder.endswith("ledger"):
            raise OSError("lost")
        put(df, folder)

    monkeypatch.setattr(ingest_stream, "_put", broken)
    with pytest.raises(Exception, match="lost"):
        ingest_stream.ingest(spark, src, out, state, SMALL)
    monkeypatch.setattr(ingest_stream, "_put", put)
    assert [d["batch"] for d in ingest_stream.ingest(spark, src, out, state, SMALL)] == [0]
    assert shown(spark, out) == {"1": [("one", 0)], "2": [("two", 0)]}


def test_ingest_of_nothing_and_of_one_file(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([], DOCS).write.parquet(src)
    out = str(tmp_path / "out")
    ingest_stream.ingest(spark, src, out, str(tmp_path / "state"), SMALL)
    assert rows(ingest_stream.current(spark, out)) == []
    add(spark, str(tmp_path / "more"), [(7, "seven")])
    name = next(x for x in os.listdir(tmp_path / "more") if x.endswith(".parquet"))
    ingest_stream.ingest(spark, str(tmp_path / "more" / name), str(tmp_path / "o2"), str(tmp_path / "s2"), SMALL)
    assert shown(spark, str(tmp_path / "o2")) == {"7": [("seven", 0)]}


def test_report_keeps_other_depths(spark, tmp_path):
    docs, asked, out = (str(tmp_path / x) for x in ("docs", "asked", "out"))
    add(spark, docs, [(1, "alpha beta gamma"), (2, "alpha"), (3, None), (4, "x  Alpha\nBETA y"), (5, "delta")])
    spark.createDataFrame([(1, "alpha beta"), (2, "nowhere"), (3, None)], "item_id long, text string").write.parquet(asked)
    cfg = retention_report.Config(depths=(1, 3))
    done = retention_report.report(spark, docs, asked, out, cfg)
    assert done == {"documents": 5, "questions": 3, "rows_written": 6, "retained": {1: 0.3333, 3: 0.3333}}
    table = lambda: rows(retention_report.read(spark, out).select("query_id", "depth", "n_hits", "context_tokens", "first_rank", "retained"))
    first = table()
    assert first == sorted([(1, 1, 1, 3, 1, True), (1, 3, 3, 8, 1, True), (2, 1, 0, 0, None, False), (2, 3, 0, 0, None, False), (3, 1, 0, 0, None, False), (3, 3, 0, 0, None, False)], key=repr)
    retention_report.report(spark, docs, asked, out, cfg)
    assert table() == first
    retention_report.report(spark, docs, asked, out, retention_report.Config(depths=(2,)))
    assert [r for r in table() if r[1] != 2] == first and len(table()) == 9
    with pytest.raises(ValueError):
        retention_report.report(spark, docs, asked, out, retention_report.Config(depths=(0,)))


def test_configuration(tmp_path):
    assert configured(ingest_stream.Config, os.path.join(ROOT, "jobs", "ingest_stream.json")).line_paragraphs
    assert list(configured(retention_report.Config, os.path.join(ROOT, "jobs", "retention_report.json")).depths) == [1, 5, 10, 20]
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps({"depth": 1}))
    with pytest.raises(ValueError, match="depth"):
        configured(retention_report.Config, str(odd))


@pytest.mark.parametrize("job, flags", [("ingest_stream", ("documents", "out", "checkpoint")), ("retention_report", ("documents", "questions", "out"))])
def test_command_line(spark, tmp_path, job, flags):
    places = {"documents": f"{DATA}/documents.parquet", "questions": f"{DATA}/benchmark.parquet", "out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "state")}
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    argv = [sys.executable, "-m", f"jobs.{job}", "--config", f"jobs/{job}.json", *(x for f in flags for x in (f"--{f}", places[f]))]
    done = subprocess.run(argv, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and f"{job} {places['out']}" in done.stderr
    assert spark.read.parquet(places["out"] + ("/chunks" if job == "ingest_stream" else "")).count() > 0


@pytest.mark.parametrize("name", list(jobs.QUERIES))
def test_queries_equal_their_sql(spark, name):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    got = jobs.QUERIES[name](spark, DATA)
    want = c.execute(f"select {', '.join(f'\"{x}\"' for x in got.columns)} from ({jobs.ORACLE_SQL[name]})").fetchall()
    assert rows(got) == sorted(want, key=repr) and want
