"""Sentence ends learned from a corpus: counts against brute force and SQL, splits against hand-marked texts and the rules."""

import math
import random
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera import catalog
from tessera.config import Settings
from tessera.functions import segment, splitters
from tessera.functions.splitters import LearnedSplitter, RuleSplitter
from tessera.operators import boundaries, chunking

#: Sentences by hand; what stands between them is a space. Their abbreviations are in no list.
MARKED = [
    "The committee met in Dept. Four of the building.",
    "It heard Gov. Alvarez on the budget.",
    "The budget was approved by all members.",
    "Later Capt. Moreau spoke of the harbour.",
    "The harbour has been closed since Feb. 12 of that year.",
    "He left with Lt. Brandt before noon.",
    "The members agreed on a plan for the harbour.",
    "A letter by J. Okafor was read aloud.",
    "It named the warehouse of Marlow Bros. Nobody objected.",
    "The vote was taken at noon.",
    "It passed by 14 to 3.",
    "The committee thanked Gov. Alvarez and Capt. Moreau.",
]
ABBREVIATED = ["Gov. Alvarez", "Gov. Tanaka", "Capt. Moreau", "Capt. Ruiz", "Lt. Brandt", "Lt. Owens", "Dept. Four", "Dept. Nine", "Feb. 12", "Feb. 3", "Marlow Bros."]


def corpus(n=400):
    """Prose in which the abbreviations stand among other words, and other words end sentences or not."""
    rng = random.Random(7)
    words = "the committee harbour members budget plan letter vote noon building year warehouse".split()
    first = "the it he later nobody a members".split()
    out = []
    for _ in range(n):
        s = [rng.choice(first).capitalize(), *rng.choices([*words, *first], k=rng.randrange(3, 9)), rng.choice(ABBREVIATED), *rng.choices([*words, *first], k=rng.randrange(0, 6)), rng.choice(words) + "."]
        out.append(" ".join(s))
    return [" ".join(out[i : i + 8]) for i in range(0, n, 8)]


def model(spark, texts, least=5):
    return boundaries.learn(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), least)


@pytest.fixture(scope="module")
def learned(spark):
    return LearnedSplitter.of(model(spark, corpus()).cache())


def score(splitter):
    text, ends, at = " ".join(MARKED), set(), 0
    for s in MARKED:
        parts = s.split("Bros. ")  # one entry holds two sentences
        for i, p in enumerate(parts):
            at += len(p) + (5 if i < len(parts) - 1 else 0)
            ends.add(at)
            at += 1
    ends.discard(len(text))
    got = {e for e in splitter.ends(text) if e < len(text)}
    return 2 * len(ends & got) / (len(ends) + len(got)), ends, got


def test_better_than_rules_on_marked_texts(learned):
    rules, learnt = score(RuleSplitter()), score(learned)
    assert rules[0] < 0.85 and learnt[0] > 0.95, (rules[0], learnt[0], learnt[1] ^ learnt[2])


def test_what_is_learned(spark):
    got = model(spark, corpus()).collect()
    kinds = {k: {(r["word"], r["next"]) for r in got if r["kind"] == k} for k in {r["kind"] for r in got}}
    assert {w for w, _ in kinds["abbreviation"]} == {"gov", "capt", "lt", "dept", "feb", "bros"}
    assert {("capt", "moreau"), ("gov", "alvarez"), ("dept", "four"), ("feb", "0")} <= kinds["collocation"]
    assert not {"committee", "noon"} & {w for k in kinds for w, _ in kinds[k] if k != "common"}


def brute_types(texts):
    n, stop, lower, upper, pair = Counter(), Counter(), Counter(), Counter(), Counter()
    r = {k: splitters.regex.compile(getattr(splitters, k)) for k in ("STOP", "OPENING", "END_BEFORE")}
    for line in (x for t in texts if t for x in t.split("\n")):
        before = None
        for word in splitters.WORD_AFTER.findall(line):
            w = splitters.word_type(word)
            bare = r["OPENING"].sub("", word)
            if w is not None:
                n[w] += 1
                stop[w] += bool(r["STOP"].search(word))
                lower[w] += bool(splitters.regex.match(r"\p{Ll}", bare))
                upper[w] += before is not None and not r["END_BEFORE"].search(before) and bool(splitters.regex.match(r"\p{Lu}", word))
                if before is not None and r["STOP"].search(before) and splitters.regex.match(r"[\p{Lu}0-9]", bare) and splitters.word_type(before) is not None:
                    pair[splitters.word_type(before), w] += 1
            before = word
    return {w: (n[w], stop[w], lower[w], upper[w]) for w in n}, dict(pair)


def odd_texts():
    rng = random.Random(3)
    bits = ["e.g.", "U.S.", "(etc.)", "“Dr.", "Dr.,", "...", "wait...", "3.", "1,000.5", "-7", "Ärzte", "ärzte.", "x", "X.", "„Ja.“", "a b.", "—", ".", "?", "No!", "end.”", "\t", "b.c", "«Oui.»", "日本。", "Z:"]
    return [None, "", "\n\n", *(rng.choice([" ", "  ", "\n"]).join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(200))]


def test_counts_are_those_of_brute_force(spark):
    texts = odd_texts() + corpus(80)
    types, pairs = brute_types(texts)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    assert {r[0]: tuple(r)[1:] for r in boundaries.types(df).collect()} == types
    assert {(r[0], r[1]): r[2] for r in boundaries.pairs(df).collect()} == pairs and pairs
    total, stops = sum(v[0] for v in types.values()), sum(v[1] for v in types.values())

    def value(w):
        n, k = types[w][:2]
        length = max(len(w.replace(".", "")), 1)
        ll = lambda p: k * math.log(p) + (n - k) * math.log(1 - p)
        return 2 * (ll(0.99) - ll(stops / total)) * math.exp(-length) * (1 + w.count(".")) * float(length) ** -(n - k)

    want = {w: value(w) for w, v in types.items() if w != "0" and v[1] and v[0] >= 5}
    got = {r["word"]: r["score"] for r in boundaries.learn(df).where("kind = 'abbreviation'").collect()}
    assert got == pytest.approx({w: x for w, x in want.items() if x >= 0.3}) and got


@pytest.mark.parametrize("least", [1, 5])
def test_equal_to_sql_on_odd_texts(spark, least):
    import duckdb
    import pandas as pd

    frame = pd.DataFrame({"text": odd_texts() + corpus(160)})  # noqa: F841
    want = duckdb.sql(catalog.ends_sql("select coalesce(text, '') \"text\" from frame", least)).fetchall()
    got = model(spark, list(frame["text"]), least).withColumn("score", F.round("score", 6)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want)) and len({r["kind"] for r in got}) >= 4


def test_association_of_a_table_of_counts(spark):
    a, b, both, n = 40.0, 60.0, 25.0, 5000.0
    xlogx = lambda x: x * math.log(x) if x else 0.0
    cells = [both, a - both, b - both, n - a - b + both]
    g = 2 * (sum(map(xlogx, cells)) - sum(map(xlogx, (a, n - a, b, n - b))) + xlogx(n))  # the same ratio as a G test
    got = spark.range(1).select(boundaries.association(*(F.lit(x) for x in (a, b, both, n)))).first()[0]
    assert got == pytest.approx(g)
    assert spark.range(1).select(boundaries.association(*(F.lit(x) for x in (5.0, 5.0, 5.0, 5.0)))).first()[0] == pytest.approx(0)


def test_nothing_to_learn_from(spark):
    for texts in ([], [None, ""], ["... — !"]):
        m = model(spark, texts, 1)
        assert m.columns == ["kind", "word", "next", "n", "score"] and m.count() == 0
        s = LearnedSplitter.of(m)
        assert s.ends("One ends. Two does too. A") == [9, 23] and s.ends("") == []


def test_a_large_table_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(splitters, "MOST_ROWS", 2)
    with pytest.raises(ValueError, match="greater least"):
        LearnedSplitter.of(model(spark, corpus(80), 1))


def test_splitter_of_the_settings_is_used(spark, learned):
    docs = spark.createDataFrame([("a", 0, 0, "Later Capt. Moreau spoke of it. The members agreed on a plan."), ("b", 0, 0, "")], "doc_id string, chunk_id int, char_offset int, text string")
    cut = lambda cfg: [r["text"] for r in chunking.sentence_units(docs, cfg).orderBy("char_offset").collect()]
    assert cut(Settings(splitter=learned)) == ["Later Capt. Moreau spoke of it.", "The members agreed on a plan."]
    assert cut(Settings(min_sentence_tokens=1))[0] == "Later Capt."


def test_queries(spark):
    got = catalog.QUERIES["learned_sentence_units"](spark, DATA)
    s = LearnedSplitter.of(boundaries.learn(catalog.documents(spark, DATA)))
    want = []
    for c in catalog._chunks(spark, DATA).collect():
        want += [(c["doc_id"], c["chunk_id"], c["char_offset"] + o, t) for t, o, _ in segment.units(c["text"], 0, s.ends)]
    got = {tuple(r) for r in got.select("doc_id", "chunk_id", "char_offset", "text").collect()}
    assert got <= set(want) and {x for x in want if segment.count(x[3]) >= 4} <= got  # shorter ones may be filtered out


def test_command_line(spark, learned, tmp_path):
    from tessera.__main__ import main

    (tmp_path / "corpus").mkdir()
    for i, t in enumerate(corpus()):
        (tmp_path / "corpus" / f"{i}.txt").write_text(t)
    table, index, corp = str(tmp_path / "ends"), str(tmp_path / "index"), str(tmp_path / "corpus")
    main(["learn-ends", corp, "--out", table], spark)
    assert LearnedSplitter.of(spark.read.parquet(table)).ends(" ".join(MARKED)) == learned.ends(" ".join(MARKED))
    main(["ingest", corp, "--index", index, "--min-chunks", "1", "--out", str(tmp_path / "o")], spark)
    main(["compress", "Gov. Alvarez", "--index", index, "--ends", table, "--out", str(tmp_path / "c")], spark)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1
