"""Hand-made cases of the engine's operators; S, C, D, ... are the ids of the operator inventory, H those of its hazards."""

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import markup, segment
from tessera.functions import text as tx
from tessera.operators import assemble, chunking, metrics, mmr, retrieval, scoring, selection
from tessera.plans.compress import compress
from tessera.sources import files


def test_c1_tables_stay_whole():
    bs = segment.blocks("a\n\n[TABLE]\nx | 1\n\ny | 2\n[/TABLE]\n\nb")
    assert [(b.text, b.table) for b in bs] == [("a", False), ("[TABLE]\nx | 1\n\ny | 2\n[/TABLE]", True), ("b", False)]
    assert [b.text for b in segment.blocks("a [TABLE] b\n\nc")] == ["a [TABLE] b", "c"]
    assert segment.blocks("") == []


def test_c4_oversized_block_and_h2_overlap():
    w = lambda n, c: " ".join([c] * n)
    text = "\n\n".join([w(100, "a"), w(450, "b"), w(10, "c")])
    assert [c[2] for c in segment.chunks(text)] == [100, 450, 10]
    text = "\n\n".join([w(10, "a"), w(20, "b"), w(350, "c"), w(100, "d"), w(300, "e")])
    fixed, legacy = segment.chunks(text), segment.chunks(text, legacy=True)
    assert fixed != legacy and fixed[0] == legacy[0]


def test_d2_units():
    kinds = [k for _, _, k in segment.units("Some text here.\n```python\nx = 1\n```\n- item one\nTail text.")]
    assert kinds == ["prose", "code", "code", "code", "list", "prose"]
    assert [s for s, _ in segment.sentences("Dr. Smith paid $391.0 billion. It was fine! Yes.")] == ["Dr. Smith paid $391.0 billion.", "It was fine!", "Yes."]
    t = "First one. Second one.\n\nThird."
    assert all(t[o : o + len(s)] == s for s, o in segment.sentences(t))


def test_d6_t1_text(spark):
    x = spark.createDataFrame([("84",), ("Net sales were $391.0 billion.",), ("see Apple",)], ["t"])
    assert [r[0] for r in x.select(tx.informative_short(F.col("t"))).collect()] == [False, True, True]
    s = ["However, results were very good.", "not very good", "very 84 items", None, "", "plain"]
    x = spark.createDataFrame([(v,) for v in s], "t string")
    assert [r[0] for r in x.select(tx.strip_filler(F.col("t"))).collect()] == [", results were good.", "not very good", "very 84 items", None, "", "plain"]
    assert x.select(tx.strip_filler(F.col("t"), True)).collect()[2][0] == "84 items"


def test_d9_keeps_first_document(spark):
    x = spark.createDataFrame([("b", 0, 0, "Same  Text"), ("a", 5, 1, "same text "), ("a", 9, 2, "other")], "doc_id string, char_offset int, sentence_index int, text string")
    assert rows(chunking.exact_dedup(x, []).select("doc_id", "sentence_index")) == [("a", 1), ("a", 2)]


def test_r3_r7_bm25(spark):
    docs = spark.createDataFrame([("1", "alpha beta"), ("2", "alpha gamma gamma"), ("3", "alpha"), ("4", "")], "doc_id string, text string")
    q = spark.createDataFrame([(0, "gamma gamma"), (1, "alpha"), (2, "nothing")], "query_id int, query string")
    got = {(r[0], r[1]): r[2] for r in retrieval.bm25(docs, q, ["doc_id"]).collect()}
    assert set(got) == {(0, "2"), (1, "1"), (1, "2"), (1, "3")}
    pool = retrieval.bm25_pool(docs, q, ["doc_id"], 10)
    assert pool.groupBy("query_id").count().where("count = 4").count() == 3


def test_r8_rrf(spark):
    d = spark.createDataFrame([(0, "A", 1), (0, "B", 2)], "query_id int, doc_id string, dense_rank int")
    b = spark.createDataFrame([(0, "B", 1), (0, "C", 2)], "query_id int, doc_id string, bm25_rank int")
    f = retrieval.fuse(d, b, ["doc_id"]).orderBy("hit_rank").collect()
    assert [r["doc_id"] for r in f] == ["B", "A", "C"]
    assert f[0]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61) and f[1]["bm25_rank"] is None


def test_k6_k7(spark):
    x = spark.createDataFrame([(0, 2.0), (0, 2.0), (1, 1.0), (1, 3.0)], "query_id int, v double")
    assert [r[0] for r in x.select(scoring.min_max("v")).collect()] == [0.0, 0.0, 0.0, 1.0]
    assert Settings(weight_cross=7, weight_bm25=3).weights() == pytest.approx((0.7, 0.3))
    with pytest.raises(ValueError):
        Settings(weight_cross=0, weight_bm25=0).weights()


def _mmr_model(rel, sims, lam, limit):
    left, kept, out = list(range(len(rel))), [], []
    while left:
        near = lambda i: max((sims[i][j] for j in kept), default=0.0)
        i = max(left, key=lambda i: ((rel[i] if not kept else round(lam * rel[i] - (1 - lam) * max(0, near(i)), 12)), -i))
        left.remove(i)
        if kept and near(i) >= limit - 1e-12:
            out.append(i)
        else:
            kept.append(i)
    return kept, out


def test_m3_m4_greedy_against_model():
    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        bags = [[rng.choice("abcd") for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 9))]
        v = mmr.unit_rows(bags)
        rel = np.array([rng.random() for _ in bags])
        got = mmr.greedy(rel, v, 0.7, 0.85)
        kept, gone = _mmr_model(rel, np.round(v @ v.T, 12), 0.7, 0.85)
        assert [g[0] for g in got if not g[4]] == kept and [g[0] for g in got if g[4]] == gone


def test_m5_unrelated_has_no_nearest(spark):
    x = spark.createDataFrame([(0, "s1", "aa", 1, 0.9), (0, "s2", "bb", 2, 0.5), (0, "s3", "aa", 3, 0.4)], "query_id int, sid string, text string, cand_idx int, relevance double")
    r = {x["sid"]: x for x in mmr.mmr(x).collect()}
    assert r["s2"]["redundant_with"] is None and r["s2"]["drop_reason"] is None
    assert r["s3"]["drop_reason"] == "redundant with s1 (sim 1.00)" and r["s3"]["mmr_rank"] == 3


def test_b1_to_b7_selection(spark):
    c = [(0, "a", 0.9, 50, 1), (0, "b", 0.8, 40, 2), (0, "c", 0.5, 30, 3), (0, "d", 0.3, 10, 4), (0, "e", 0.1, 1, 5), (1, "x", 0.9, 900, 1), (1, "y", 0.8, 1, 2)]
    x = spark.createDataFrame(c, "query_id int, sid string, relevance double, token_count int, mmr_rank int")
    x = x.withColumn("mmr_score", F.lit(None).cast("double")).withColumn("drop_reason", F.lit(None).cast("string"))
    r = {k["sid"]: k for k in selection.select(x, Settings(budget=100)).collect()}
    assert [s for s in "abcdexy" if r[s]["selected"]] == ["a", "b", "d", "x"]
    assert r["e"]["drop_reason"] == "low relevance (0.10)" and r["y"]["drop_reason"] == "over budget" and r["c"]["drop_type"] == "over budget"
    assert selection.select(x, Settings(budget=None)).where("selected").count() == 6


def test_a1_assembly(spark):
    x = spark.createDataFrame([(0, "b", 0, "One.", 1), (0, "a", 0, "Two.", 2), (0, "a", 5, "Three.", 3), (0, "a", 0, "Twin.", 4)], "query_id int, doc_id string, char_offset int, shown string, mmr_rank int")
    x = x.withColumn("chunk_id", F.lit(0)).withColumn("sentence_index", F.col("mmr_rank"))
    assert assemble.compressed(x, ["query_id"]).first()["context"] == "[SOURCE: a]\nTwo.\nTwin.\nThree.\n\n[SOURCE: b]\nOne."
    assert assemble.compressed(x.where("mmr_rank <> 4"), ["query_id"]).first()["context"].startswith("[SOURCE: a]\nTwo.\n[...]\nThree.")


def test_g1_distribution(spark):
    want = {1: 1, 2: 2, 5: 5, 10: 10, 20: 20, 40: 38, 60: 58, 100: 96}
    x = spark.createDataFrame([(n, float(v)) for n in want for v in range(1, n + 1)] + [(0, None)], "g int, v double")
    r = {k["g"]: k for k in metrics.distribution(x, ["g"], "v").collect()}
    assert {n: r[n]["p95"] for n in want} == want and r[0]["n"] == 0 and r[0]["p95"] is None and r[0]["median"] is None


def test_g4_calibration_and_g6(spark):
    x = spark.createDataFrame([(10, 80), (30, 100), (20, 90)], "local_tokens int, server_tokens int")
    c = metrics.calibration(x).first()
    assert c["exact"] and c["slope_per_1k"] == pytest.approx(0) and c["mean_delta"] == 70
    assert spark.range(1).select(metrics.ratio(F.lit(0), F.lit(1))).first()[0] is None


def test_f1_html():
    page = "<head><title>x</title></head><p>One&nbsp;two</p><table><tr><td>a</td><td> </td><td>b  c</td></tr><tr><td></td></tr></table><script>s()</script><div>End</div>"
    assert markup.to_text(page) == "One two\n\n[TABLE]\na | b c\n[/TABLE]\n\nEnd"
    assert markup.to_text(None) == "" and markup.to_text("<table></table>x") == "x"


def test_s1_s4_s7_s8_sources(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "b.txt").write_text("Beta text.\n\nMore.")
    (tmp_path / "c" / "a.md").write_text("Alpha")
    docs = files.read_corpus(spark, str(tmp_path / "c"))
    assert rows(docs.select("doc_id")) == [("a",), ("b",)]
    ch = chunking.chunks(docs)
    assert files.write_index(ch, str(tmp_path / "i")).count() == ch.count()
    assert files.append_index(ch, str(tmp_path / "i")) == ch.count()
    with pytest.raises(ValueError):
        chunking.require_chunks(ch, 200)
    f = spark.createDataFrame([(["8-K", "10-K", "10-K"], ["0-1", "0-2", "0-3"]), (["8-K"], ["1"])], "forms array<string>, accessions array<string>")
    assert [r["accession"] for r in files.latest_filing(f).collect()] == ["02", None]
    assert files.eval_results(spark, str(tmp_path / "none.json")).first()["available"] is False


def test_pipeline_and_stream(spark, tmp_path):
    from tessera.streaming.streams import compress_stream

    docs = spark.createDataFrame([("d1", "Apples are red and sweet.\n\nThey grow on trees in Europe."), ("d2", "Cars need fuel to drive.\n\nApples are cheap this year.")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "apples sweet"), (2, "zzz")], "query_id int, query string")
    ch = chunking.chunks(docs).persist()
    c = compress(ch, q, Settings(budget=50))
    s = {r["query_id"]: r for r in c.summary.collect()}
    assert set(s) == {1, 2} and s[1]["n_kept"] >= 1 and s[1]["selected_tokens"] <= 50
    q.write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "q"))
    compress_stream(stream, ch, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_d2_fences_and_blank_code_lines_count():
    text = "Some prose here.\n  ```\ncode line\n\nmore\n  ~~~\n- item"
    assert [u[0] for u in segment.units(text)] == ["Some prose here.", "```", "code line", "", "more", "~~~", "- item"]


def test_s1_bad_bytes_become_replacements(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff\xfe end")
    assert files.read_corpus(spark, str(tmp_path)).first()["text"] == "ok �� end"


def test_s7_upsert_replaces_the_same_uid_and_lookup_keeps_ranks(spark, tmp_path):
    folder, schema = str(tmp_path / "index"), "doc_id string, chunk_id int, text string, uid long"
    files.write_index(spark.createDataFrame([("a", 0, "old", 1), ("a", 1, "kept", 2)], schema), folder)
    assert files.upsert_index(spark.createDataFrame([("a", 0, "new", 1), ("b", 0, "more", 3)], schema), folder) == 1
    index = files.scan_index(spark, folder)
    assert [tuple(r) for r in index.collect()] == [("a", 0, "new", 1), ("a", 1, "kept", 2), ("b", 0, "more", 3)]
    ranked = spark.createDataFrame([(7, 3, 1), (7, 99, 2)], "query_id int, uid long, rank int")
    assert [(r["rank"], r["text"]) for r in files.lookup(index, ranked).orderBy("rank").collect()] == [(1, "more"), (2, None)]


def test_s11_a_key_stored_twice_counts_once(spark):
    rows_ = spark.createDataFrame([(1, "q", "t")], "query_id int, query string, text string")
    key = rows_.select(tx.cache_key(F.lit("m"), F.col("query"), F.col("text"))).first()[0]
    cache = spark.createDataFrame([(key, 0.5), (key, 0.5)], "k string, v double")
    hit, miss = scoring.probe_cache(rows_, cache, "m", ["query", "text"])
    assert hit.count() == 1 and miss.count() == 0


def test_g1_distribution_of_many_ties_and_nulls(spark):
    import statistics

    for n in (1, 2, 19, 20, 41):
        v = [float(i // 3) for i in range(n)]
        r = metrics.distribution(spark.createDataFrame([("a", x) for x in v] + [("a", None), ("b", None)], "g string, x double"), ["g"], "x").orderBy("g").collect()
        at = max(1, min(n, round(0.95 * n + 0.5)))
        assert tuple(r[0])[1:] == (n, statistics.median(v), v[at - 1], v[0], v[-1]) and tuple(r[1]) == ("b", 0, None, None, None, None)


def test_d9_least_of_a_group_with_nulls_and_clashing_columns(spark):
    x = spark.createDataFrame([("b", 0, 0, None, 1), ("a", 5, 1, None, 2), ("a", 9, 2, "x Y", 3), ("a", 9, 1, "x  y", 4)], "doc_id string, char_offset int, sentence_index int, text string, _first int")
    kept = chunking.exact_dedup(x, [])
    assert kept.columns == x.columns and rows(kept) == [("a", 5, 1, None, 2), ("a", 9, 1, "x  y", 4)]
    assert rows(chunking.exact_dedup(x.limit(0), [])) == []


def test_g2_g8_report_of_runs(spark):
    paths = spark.createDataFrame([(1, 7, "baseline", 1000, 50.0, 90.0, 10, 0, None, 1100, 0.0), (1, 7, "compressed", 400, 30.0, 60.0, 20, 0, None, None, 8.0)], "run_id int, query_id int, path string, context_tokens int, ttft_ms double, total_latency_ms double, completion_tokens int, cached_tokens int, error string, prompt_tokens int, overhead_ms double")
    from tessera.engine import Engine

    got = {r["metric"]: r for r in Engine(spark, "").ab(paths, 1.0, 2.0).collect()}
    assert len(got) == 13 and got["overhead_ms"]["median"] == 8.0 and got["b_cost"]["median"] == 1120 / 1e6
    assert got["c_cost"]["n"] == 0 and got["c_cost"]["median"] is None and abs(got["cost_saved"]["median"] - 580 / 1e6) < 1e-12
    plain = {r["metric"]: r for r in Engine(spark, "").ab(paths.drop("prompt_tokens", "overhead_ms"), 1.0, 2.0).collect()}
    assert len(plain) == 13 and plain["b_cost"]["n"] == 0 and plain["overhead_ms"]["median"] is None


def test_engine_and_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main

    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "a.txt").write_text("Apples are red and sweet.\n\nThey grow on trees in Europe.")
    (corpus / "b.md").write_text("Cars need fuel to drive.\n\nApples are cheap this year.")
    at = ["--index", str(tmp_path / "index")]
    with pytest.raises(ValueError):
        main(["ingest", str(corpus), *at], spark)
    main(["ingest", str(corpus), "--min-chunks", "1", *at], spark)
    assert json.loads(capsys.readouterr().out)["n_chunks"] == 2
    main(["retrieve", "apples sweet", "cars", *at], spark)
    hits = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [h["doc_id"] for h in hits if h["hit_rank"] == 1] == ["a", "b"]
    main(["compress", "apples sweet", "--budget", "0", "--contexts", *at], spark)
    assert "Apples are red and sweet." in json.loads(capsys.readouterr().out)["context"]
    main(["describe", "--out", str(tmp_path / "out"), *at], spark)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(2, 2)]
