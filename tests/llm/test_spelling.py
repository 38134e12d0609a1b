"""Spelling variants against brute force."""

import collections
import os
import random
import re
import zlib

import pytest
from conftest import DATA

from tessera.llm import spelling


def near(a, b):
    """Exactly one insertion, deletion or replacement."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def count(docs, noise=199):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def grouped(n):
    form, near_n = {}, {}
    for w in n:
        around = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        near_n[w] = len(around)
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near_n[w], n.get(form[w])))
    return sorted(out)


def answer(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_groups_equal_brute_force(spark):
    rng = random.Random(9)
    n = {}
    for _ in range(60):
        w = "".join(rng.choice("abéx") for _ in range(rng.randint(6, 9)))
        for _ in range(12):  # chains of edits, some of them deep
            n[w] = rng.choice([5, 5, 25, 125, 700, 4000, 25])
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abéx") + w[i:], w[:i] + rng.choice("abéx") + w[i + 1 :]])
            w = w if len(w) >= 6 else w + "abx"
    got = answer(spelling.group(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == grouped(n)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of two forms at least


def test_words_of_texts_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["Straßenbahn", "NAIVETY", "bañanana", "ÉcoleÉcole", "colour", "color", "colours", "short", "aaaaaaa", "aaaaaaaa", "x×÷xyzz"]
    docs = [(i if i % 7 else None, " ".join(rng.choice(words) for _ in range(400)) + "-;\n" + rng.choice(words)) for i in range(40)] + [(90, None), (91, ""), (92, " 12 _"), (3, "colour " * 30_000), (3, "colour " * 30_000)]
    d = spark.createDataFrame([(i, t, "n", 1, "w") for i, t in docs], "doc_id long, text string, n string, word int, form string")
    got = answer(spelling.variants(d, noise=7))
    assert got == grouped(count(docs, 7)) and got
    assert spelling.variants(d.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(d, min_length=3)
    with pytest.raises(ValueError):
        spelling.group(spelling.word_counts(d), ratio=1)


def test_query_over_whole_table(spark):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert answer(spelling.op12_spelling_variants(spark, DATA)) == grouped(count(docs))
