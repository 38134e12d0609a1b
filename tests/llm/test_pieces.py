"""The table of distinct marked words against the library's whole-text encoding."""

import hashlib
import os
import random

import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA

from tessera.llm import pieces

DOCS = "doc_id long, text string, lang string, ids string, word string, key string, rare int"


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def texts():
    rng = random.Random(5)
    odd = ["", None, " ", "   ", "a", " a ", "a  b   c", "\n\n", "tab\there\r\nline", "x▁y", "▁", "▁ ▁", "café 中文 \U0001f600 ﬁ", "  ", "<s> </s> <unk> <0x0A>", "nul\0nul", "é ü"]
    alphabet = "abcde  ▁\né中\U0001f600.,1"
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(120)] + ["w" * 3000, " ".join(f"w{i % 97}" for i in range(30_000))]


def expected(sp, text):
    ids = sp.encode(text or "", num_threads=1)
    return ids, sp.decode(ids)


@pytest.mark.parametrize("tail", ["segment", "join"])
@pytest.mark.parametrize("common", [100_000, 20, 0])
def test_equals_the_library(spark, sp, common, tail):
    data = [(i, t, "en", "x", "y", "z", 1) for i, t in enumerate(texts())]
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.decode(pieces.encode(spark.createDataFrame(data, DOCS), common_words=common, tail=tail)).collect()}
    assert got == {i: expected(sp, t) for i, t, *_ in data}


@pytest.mark.parametrize("common, tail", [(100_000, "segment"), (1, "segment"), (1, "join")])
def test_repeated_rows_and_ids(spark, sp, common, tail):
    data = [(1, "same same"), (1, "same same"), (1, "another text"), (None, "no id"), (None, "no id either"), (2, None)]
    d = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], DOCS)
    got = sorted(repr((r["doc_id"], r["ids"])) for r in pieces.encode(d, common_words=common, tail=tail).collect())
    assert got == sorted(repr((i, sp.encode(t or ""))) for i, t in data)
    assert pieces.decode(pieces.encode(d.limit(0))).collect() == []


def test_words_of_a_text(spark):
    d = spark.createDataFrame([(1, "a b a b  a"), (2, "a b")], "doc_id long, text string")
    t = {r["word"]: r["n"] for r in pieces.word_counts(d).collect()}
    assert t == {"▁a": 3, "▁b": 3, "▁▁a": 1}


def test_bounds_of_the_common_table(spark):
    t = spark.createDataFrame([(f"w{i:02}", 1 << (i % 10)) for i in range(100)], "word string, n long")
    assert t.where(pieces._common(t, 25, 1 << 20)).count() == 20  # two levels of ten words
    assert t.where(pieces._common(t, 100, 290)).count() == 10  # a word counts 15 bytes
    assert t.where(pieces._common(t, 5, 1 << 20)).count() == 0


def test_query_over_whole_table(spark, sp):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids, back = expected(sp, r["text"])
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(back)))
    assert sorted(map(tuple, pieces.op11_distinct_chunk_pieces(spark, DATA).collect())) == sorted(want)
