"""Token counters: a rank vocabulary against the library that made its format, and counts all through the engine."""

import base64
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions.tokens import RankCounter, RegexCounter, merged
from tessera.operators import chunking
from tessera.plans.compress import compress

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter(spark):
    return RankCounter.read(spark, FILE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_all_texts(spark, counter, library):
    for name, key in (("documents", "doc_id"), ("pages", "page_id"), ("conversations", "conv_id")):
        t = spark.read.parquet(f"{DATA}/{name}.parquet")
        text = F.col("html" if name == "pages" else "text")
        rows = t.select(text.alias("text"), counter.column(text).alias("n")).collect()
        assert rows and all(r["n"] == (None if r["text"] is None else len(library.encode_ordinary(r["text"]))) for r in rows)


def test_counts_of_odd_texts(counter, library):
    rng = random.Random(5)
    chars = " \n\t\r  'sdtrevml019aAéßÄ漢字🙂́‍<|>.,_-\0"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "a" * 5000, "ab" * 3000, "the" * 2000, "<|endoftext|> is text", "x\n\n  y", "🙂" * 500, "don't we'll I'VE"]
    for t in texts:
        assert counter.count(t) == len(library.encode_ordinary(t)), t[:60]


def test_first_of_equal_ranks_is_joined_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300}
    assert merged(b"aaa", ranks) == 2 and merged(b"aaaa", ranks) == 2 and merged(b"", ranks) == 0 and merged(b"z", ranks) == 1


def test_all_counts_of_a_compression_are_the_counters(spark, counter):
    text = "\n\n".join(f"Paragraph {i} tells of unbelievably rare reservoir engineering, number {i * 37}." for i in range(60))
    docs = spark.createDataFrame([("a", text), ("b", text[:900]), ("c", "")], "doc_id string, text string")
    cfg = Settings(counter=counter, chunk_tokens=120, budget=90)
    for df in (chunking.blocks(docs, cfg), chunking.chunks(docs, cfg), chunking.sentence_units(chunking.chunks(docs, cfg), cfg)):
        rows = df.collect()
        assert rows and all(r["token_count"] == counter.count(r["text"]) for r in rows)
    assert any(r["token_count"] != RegexCounter().count(r["text"]) for r in chunking.chunks(docs, cfg).collect())
    q = spark.createDataFrame([(1, "rare reservoir number 74")], "query_id long, query string")
    done = compress(chunking.chunks(docs, cfg), q, cfg)
    s, c = done.summary.first(), done.contexts.first()
    assert s["token_counter"] == "byte_bpe_50k.tiktoken" and s["selected_tokens"] <= 90
    assert s["compressed_context_tokens"] == counter.count(c["context"]) and s["baseline_context_tokens"] == counter.count(c["baseline_context"])


def test_the_first_readable_file_is_taken(spark, tmp_path):
    (tmp_path / "bad").write_text("no ranks here\n")
    (tmp_path / "few").write_text(base64.b64encode(b"a").decode() + " 0\n")
    bad = [str(tmp_path / "none"), str(tmp_path / "bad"), str(tmp_path / "few")]
    assert RankCounter.resolve(spark, [*bad, FILE], public_tokenizers.PATTERN).count("a b") == 2
    with pytest.raises(ValueError, match="none.*bad is no rank file.*lacks ranks"):
        RankCounter.resolve(spark, bad, public_tokenizers.PATTERN)


def test_command_line_takes_a_rank_file(spark, counter, tmp_path):
    from tessera.__main__ import main

    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.txt").write_text("Unbelievably rare reservoirs.\n\nAnd others.")
    main(["ingest", str(tmp_path / "corpus"), "--index", str(tmp_path / "i"), "--min-chunks", "1", "--ranks", FILE, "--pattern", public_tokenizers.PATTERN, "--out", str(tmp_path / "o")], spark)
    text = "Unbelievably rare reservoirs.\n\nAnd others."
    assert spark.read.parquet(str(tmp_path / "o")).first()["total_tokens"] == counter.count(text)


def test_subword_counts_query(spark, counter):
    from tessera import catalog

    texts = dict(catalog.documents(spark, DATA).collect())
    got = catalog.QUERIES["subword_counts"](spark, DATA).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: counter.count(t) for k, t in texts.items()} and len(got) == len(texts)
