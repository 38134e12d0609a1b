"""The chunk index: documents added, replaced and removed, equal to an index made afresh, and its guards."""

import json

import pytest
from conftest import rows

from tessera.config import Settings
from tessera.engine import Engine
from tessera.operators import chunking
from tessera.sources.index import ChunkIndex

CFG = Settings(chunk_tokens=6, index_buckets=4, min_chunks=1)
DOCS = "doc_id string, text string"


def made(spark, docs, folder, cfg=CFG):
    return ChunkIndex.create(chunking.chunks(spark.createDataFrame(docs, DOCS), cfg), folder, cfg.index_buckets)


def state(engine):
    q = ["apples sweet", "cars fuel", "new words"]
    return rows(engine.chunks().drop("bucket")), rows(engine.retrieve(q).drop("bucket"))


BASE = [(f"d{i}", f"Apples are sweet {i}.\n\nCars need fuel number {i} to go.\n\nLast line of it.") for i in range(12)]


def test_changes_equal_a_fresh_index(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "a"), CFG)
    made(spark, BASE, engine.index)
    # d1 becomes shorter, d2 empty, d99 is new, rows repeat
    change = [("d1", "New words."), ("d2", ""), ("d99", "New words\n\nand sweet apples in many more words than fit."), (None, "nameless")]
    new = engine.add(spark.createDataFrame(change, DOCS).where("doc_id is not null"))
    assert new["after"] - new["before"] != 0
    assert rows(engine.chunks().where("doc_id = 'd1'").select("text")) == [("New words.",)]  # nothing of the old text
    left = [x for x in BASE if x[0] not in ("d1", "d2")] + change[:3]
    made(spark, left, str(tmp_path / "b"))
    assert state(engine) == state(Engine(spark, str(tmp_path / "b"), CFG))

    engine.remove(spark.createDataFrame([("d99",), ("d3",), ("unknown",)], "doc_id string"))
    made(spark, [x for x in left if x[0] not in ("d99", "d3")], str(tmp_path / "c"))
    assert state(engine) == state(Engine(spark, str(tmp_path / "c"), CFG))
    once = state(engine)
    engine.remove(spark.createDataFrame([("d99",), ("d3",)], "doc_id string"))  # again: the same
    assert state(engine) == once


def test_bucket_may_become_empty_and_fill_again(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "i"), CFG)
    made(spark, [("a", "apples sweet")], engine.index)
    a = spark.createDataFrame([("a",)], "doc_id string")
    assert engine.remove(a) == {"before": 1, "after": 0}
    assert rows(engine.retrieve(["apples"])) == [] and rows(engine.describe()) == [(0, 0)]
    assert engine.add(spark.createDataFrame([("a", "cars fuel")], DOCS)) == {"before": 0, "after": 1}
    assert [r["text"] for r in engine.retrieve(["fuel"]).collect()] == ["cars fuel"]


def test_guards(spark, tmp_path):
    with pytest.raises(ValueError, match="needed"):
        ChunkIndex.create(chunking.chunks(spark.createDataFrame([("a", "x")], DOCS)), str(tmp_path / "i"), 2, least=5)
    with pytest.raises(ValueError, match="a#0 comes 2 times"):
        made(spark, [("a", "x"), ("a", "y")], str(tmp_path / "j"))


def test_failed_change_runs_again(spark, tmp_path, monkeypatch):
    from tessera.sources import index as module

    engine = Engine(spark, str(tmp_path / "i"), CFG)
    made(spark, BASE, engine.index)
    change = spark.createDataFrame([("d1", "New words."), ("d5", "More new words.")], DOCS)
    keep = module.lexical.replace
    monkeypatch.setattr(module.lexical, "replace", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        engine.add(change)
    monkeypatch.setattr(module.lexical, "replace", keep)
    engine.add(change)
    made(spark, [x for x in BASE if x[0] not in ("d1", "d5")] + [("d1", "New words."), ("d5", "More new words.")], str(tmp_path / "b"))
    assert state(engine) == state(Engine(spark, str(tmp_path / "b"), CFG))


def test_command_line_adds_and_takes_flags(spark, tmp_path, capsys):
    from tessera.__main__ import main

    for name, text in (("one", "Very sweet apples grow in the garden of our house."), ("two", "Cars need fuel.")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "doc.txt").write_text(text)
    at = ["--index", str(tmp_path / "index")]
    main(["ingest", str(tmp_path / "one"), "--min-chunks", "1", *at], spark)
    main(["compress", "apples garden", "--contexts", "--strip", "--lambda", "0.5", "--threshold", "0", *at], spark)
    assert "[SOURCE: doc]\nsweet apples" in json.loads(capsys.readouterr().out.splitlines()[-1])["context"]
    main(["add", str(tmp_path / "two"), *at], spark)
    assert json.loads(capsys.readouterr().out) == {"before": 1, "after": 1}
    main(["retrieve", "fuel", *at], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[0])["text"] == "Cars need fuel."
