"""The training-data operators against brute force, exact round trips and hand-made edge cases."""

import collections
import glob
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, htmltext, kneserney, langid, linededup, ngramjoin, packing, quality, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, h string"


def make(spark, texts):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None, len(t or ""), 7, "x") for i, t in texts], DOCS)


def edge(spark):
    """Nulls, empty, long and repeated texts, and columns with clashing names."""
    long = " ".join(f"w{i % 97}" for i in range(6000))
    return make(spark, [(1, None), (2, ""), (3, long), (3, long), (4, "tie tie tie"), (5, "tie tie tie"), (None, "no id here"), (6, "  \t\n\n ")])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "tu", "ra"]) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = ["\n".join(line(rng.randint(3, 20)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    for i in range(25):
        w = texts[i % 5].split(" ")
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts + texts[:4])]


# 1
def test_quality_counts_and_edges(spark):
    text = "a b c a b c x\n\nsame line\nsame line\n# $ %" + " z" * 60
    r = quality.counts(make(spark, [(1, text)])).first()
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    assert r["n_repeat_words"] == len({i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)})
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), 3, 1)
    got = quality.verdicts(edge(spark)).collect()
    assert len(got) == 8 and all(x["base_failed"] and not x["kept"] for x in got)
    assert quality.verdicts(edge(spark).limit(0)).count() == 0


def test_quality_rejects_outliers(spark):
    rng = random.Random(1)
    clean = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(80))) for i in range(120)]
    bad = [(1000 + i, " ".join("".join(rng.choices("abcdefgh", k=5)) + "###" for _ in range(80))) for i in range(10)]
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in clean + bad], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.verdicts(d).where("kept").collect()}
    assert kept == {i for i, _ in clean}


def test_quality_judges_rare_languages(spark):
    rng = random.Random(2)
    text = lambda tail="": " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) + tail for _ in range(80))
    clean = [(i, text(), "en", "s") for i in range(120)] + [(200 + i, text(), "xx", None) for i in range(10)]
    bad = [(300, text("###"), "xx", None), (301, text("###"), None, "t")]
    read = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.verdicts(read(clean + bad)).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {r[0] for r in clean} and all(r["distance"] is not None for r in got)
    few = quality.verdicts(read(clean[-10:] + bad[:1])).collect()
    assert {r["doc_id"] for r in few if not r["kept"]} == {300}


# 2
def brute_lines(texts):
    seen, gone = [], collections.defaultdict(set)
    for i, t in sorted(texts):
        for k, x in enumerate(t.split("\n")):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", x))
            if len(s) < linededup.MIN_TOKENS:
                continue
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone[i].add(k)
            seen.append(s)
    return gone


def test_line_dedup(spark, corpus):
    got = {r[0]: set(r[1]) for r in linededup.removed_lines(make(spark, corpus)).collect()}
    assert got == brute_lines(corpus) and got
    out = {r["doc_id"]: r for r in linededup.dedup_lines(make(spark, corpus)).collect()}
    assert all(out[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got.get(i, ())) for i, t in corpus)


def test_line_dedup_crowd_and_edges(spark):
    base = [f"base{i}" for i in range(30)]
    crowd = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(j % 30 for j in range(80))]
    assert {r[0] for r in linededup.removed_lines(make(spark, crowd)).collect()} == set(range(1, 80))
    out = linededup.dedup_lines(edge(spark))
    assert out.columns[:7] == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") and out.count() == 8
    assert linededup.dedup_lines(edge(spark).limit(0)).count() == 0


def test_line_dedup_takes_short_lines(spark):
    texts = [(1, "one\none\n\n \nAll rights reserved."), (2, "a b c d\nAll rights reserved.\nb a\na b c"), (3, "e d c b a\na b\n\nreserved. All rights\nd a c"), (4, "e d c b\nnot in any other"), (5, None)]
    got = {r[0]: set(r[1]) for r in linededup.removed_lines(make(spark, texts)).collect()}
    # 4 of 5 words are 0.8, 3 of 4 are less; order does not count; lines without a word stay
    assert got == {1: {1}, 2: {1}, 3: {0, 1, 3}, 4: {0}}
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(make(spark, texts)).collect()}
    assert out[1] == "one\n\n \nAll rights reserved." and out[3] == "\nd a c" and out[5] is None


def test_line_dedup_where_no_side_is_small(spark, monkeypatch):
    """Lines longer and shorter than those of one sketch, with other spaces, on the paths of large tables."""
    monkeypatch.setattr(linededup, "fits", lambda *_: False)
    rng = random.Random(5)
    texts = []
    for i in range(60):
        n = 20 if i % 2 else linededup.LONG + rng.randint(-6, 12)
        words = [f"base{j}" for j in range(n)]
        for _ in range(rng.randint(0, n // 8)):
            words[rng.randrange(n)] = f"new{rng.randrange(200)}"
        texts.append((i, rng.choice([" ", "\t", "  ", " \r"]).join(words) + rng.choice(["", "\nbase0\x0bbase1\x0c", "\n"])))
    got = {r[0]: set(r[1]) for r in linededup.removed_lines(make(spark, texts)).collect()}
    assert got == brute_lines(texts) and len(got) > 40
    counts = {r["doc_id"]: (r["a"], r["b"]) for r in linededup.dedup_lines(make(spark, [*texts, (99, None), (98, "")]), ("a", "b")).collect()}
    assert counts == {i: (len(t.split("\n")), len(got.get(i, ()))) for i, t in texts} | {99: (0, 0), 98: (1, 0)}


def test_line_sketches_bound_the_difference(spark):
    rng = random.Random(6)
    lines = [sorted(rng.sample(range(1 << 40, (1 << 40) + (1 << 34), 12345), rng.choice([40, 60, 64, 65, 70, 90]))) for _ in range(20)]
    lines += [sorted(rng.sample(x, int(len(x) * rng.uniform(0.9, 1)))) for x in lines]
    n = F.size("t")
    sk = spark.createDataFrame([(x,) for x in lines], "t array<long>").select("t", n.alias("n"), linededup._sketch(F.col("t")).alias("sk"), F.when(n > linededup.LONG, linededup._sketch(F.col("t"), True)).otherwise(0).alias("sl"))
    a, b = sk.toDF("ta", "na", "ska", "sla"), sk.toDF("tb", "nb", "skb", "slb")
    close = linededup._close(F.col("na"), F.col("nb"), (F.col("ska"), F.col("sla")), (F.col("skb"), F.col("slb")))
    rows = a.crossJoin(b).select("ta", "tb", close.alias("close")).collect()
    alike = [9 * len(set(r["ta"]) & set(r["tb"])) >= 4 * (len(r["ta"]) + len(r["tb"])) for r in rows]
    assert all(r["close"] for r, x in zip(rows, alike) if x) and sum(alike) > 60
    assert sum(r["close"] for r in rows) < 1.5 * sum(alike)


# 3
def test_masks_find_every_window_with_two_substitutions():
    for gaps in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(all(p + o not in gaps for o in decontaminate.offsets(m)) for m in decontaminate.MASKS for p in range(decontaminate.WINDOW - len(m) + 1))


def test_short_items_are_found_with_substitutions():
    for n in range(3, decontaminate.WINDOW):
        item = [f"t{k}" for k in range(n)]
        index = decontaminate.Index([(7, " ".join(item)), (8, "some longer item " * 8)])
        for gaps in itertools.combinations(range(n), n // 5):
            text = " ".join(["before", *("sub" if k in gaps else w for k, w in enumerate(item)), "after"])
            assert index.search(text) == [(7, 1, n, n - n // 5)], (n, gaps)
        assert not index.search(" ".join("sub" if k <= n // 5 else w for k, w in enumerate(item)))


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"t{rng.randrange(400)}" for _ in range(20))) for i in range(8)]
    docs = []
    for i in range(40):
        w = [f"d{rng.randrange(400)}" for _ in range(60)]
        if i < 16:
            part = items[i % 8][1].split()
            if i >= 8:
                part = [x if k % 6 else "sub" for k, x in enumerate(part)]
            w[20:20] = part
        docs.append((i, " ".join(w)))
    bench = spark.createDataFrame(items + [(98, None), (99, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(make(spark, docs), bench).collect()}
    assert got == {(i, i % 8) for i in range(16)}
    left = decontaminate.drop_contaminated(make(spark, docs), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(16, 40))
    assert decontaminate.overlaps(edge(spark), bench).count() == 0 and decontaminate.drop_contaminated(edge(spark), bench).count() == 8
    assert decontaminate.overlaps(edge(spark), bench.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    """Every alignment of every item of 1 to 20 tokens with every text, without seeds."""
    rng = random.Random(11)
    items = [(n, " ".join(f"v{rng.randrange(60)}" for _ in range(n))) for n in range(1, 21)]
    docs = [(100, None), (101, ""), (102, "v1"), (None, items[12][1])]
    for i in range(60):
        w = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(40))]
        part = rng.choice(items)[1].split()
        part = [x if rng.random() > 0.15 else "sub" for x in part]
        docs.append((i, " ".join([*w, *part[rng.randrange(2) :], *w[:5]])))
    docs.append(docs[-1])

    def brute(text):
        t, out = re.findall(r"\w+", (text or "").lower()), set()
        for i, item in items:
            b = item.split()
            w = min(12, len(b))
            if len(b) > 2 and any(sum(t[p + k] == b[q + k] for k in range(w)) >= 0.8 * w - 1e-9 for p in range(len(t) - w + 1) for q in range(len(b) - w + 1)):
                out.add(i)
        return out

    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, hits string, row int, _row int").repartition(3)
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(frame, bench).collect())
    assert got == collections.Counter((i, k) for i, t in docs for k in brute(t)) and len(got) > 30
    left = decontaminate.drop_contaminated(frame, bench)
    assert left.columns == frame.columns and sorted(map(repr, (r["doc_id"] for r in left.collect()))) == sorted(repr(i) for i, t in docs if not brute(t))


# 4
def test_matrix_has_its_margins_and_law():
    m = sharding.matrix([7, 0, 13], [5, 5, 10], 1)
    assert m.sum(axis=1).tolist() == [7, 0, 13] and m.sum(axis=0).tolist() == [5, 5, 10]
    first = np.array([sharding.matrix([6, 6], [6, 6], s)[0, 0] for s in range(3000)])
    assert abs(first.mean() - 3) < 0.1
    x = sharding.hypergeometric(np.random.default_rng(0), 3 * 10**9, 7 * 10**9, 10**6)
    assert abs(x - 300_000) < 3000


def test_sharding(spark, corpus):
    d = make(spark, corpus).repartition(5)
    out = sharding.shuffle_into_shards(d, 4, per_cell=7).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert sorted(r["text"] for r in out) == sorted(t for _, t in corpus)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shuffle_into_shards(edge(spark)).count() == 8 and sharding.shuffle_into_shards(edge(spark).limit(0)).count() == 0


# 5
def test_bands_reach_the_recall():
    b, r = ngramjoin.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= ngramjoin.MAX_HASHES


def test_ngram_join_against_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 4)
    sets = {}
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = (tuple(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = {i: min(j for j in sets if sets[j][0] == sets[i][0]) for i in sets}
    reps, links, up = sorted(set(root.values())), collections.Counter(), {i: i for i in root.values()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(reps, 2):
        x, y = sets[a][1], sets[b][1]
        if len(x & y) >= 0.8 * len(x | y):
            links[a] += 1
            links[b] += 1
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngramjoin.join(make(spark, corpus)).collect()}
    assert got == {i: (find(root[i]), links[root[i]]) for i in sets} and sum(links.values())
    assert {r["doc_id"] for r in ngramjoin.keep_one(make(spark, corpus)).collect()} == {find(i) for i in reps}


def test_ngram_join_edges(spark):
    r = ngramjoin.join(edge(spark)).collect()
    assert len(r) == 8 and {(x["doc_id"], x["class_id"]) for x in r if x["doc_id"] in (4, 5)} == {(4, 4), (5, 4)}
    assert ngramjoin.join(edge(spark).limit(0)).count() == 0


# 6
def brute_segments(s):
    """Ruzzo and Tompa's definition: the best segment, then the same on either side of it."""
    if not len(s) or max(s) <= 0:
        return []
    best = max((sum(s[a:b]), -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1))
    a, b = best[3], best[4]
    return brute_segments(s[:a]) + [(a, b, best[0])] + [(x + b, y + b, v) for x, y, v in brute_segments(s[b:])]


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([3, 5, 2, -1, -1, -1, -1]) for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments([(i, v) for i, v in enumerate(s) if v > 0], len(s), -1)
        assert [x[2] for x in got] == [x[2] for x in brute_segments(s)]


def test_toxicity(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(["the", "of", "and"]) + rng.choice("abcdefgh") for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["badword", "nasty", "vile"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, lab = make(spark, docs), spark.createDataFrame(labels + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    m = toxicity.fit(d, lab)
    got = {r["doc_id"]: r["_tox"]["score"] for r in toxicity.score(d, m).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert toxicity.score(edge(spark), m).where("_tox.score between 0 and 1").count() == 8
    assert toxicity.drop_toxic(edge(spark), lab.limit(0)).columns == edge(spark).columns


def test_toxicity_with_partitions_without_labels(spark):
    d = make(spark, [(i, f"plain words number {i}" + (" vile nasty" if i < 2 else "")) for i in range(40)]).repartition(8)
    lab = spark.createDataFrame([(0, 1), (2, 1), (5, 0), (6, 0)], "doc_id long, toxic int")
    assert toxicity.score(d, toxicity.fit(d, lab)).where("_tox.score between 0 and 1").count() == 40
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), lab)).count() == 0


# 7
def test_min_cut_is_optimal():
    rng = random.Random(2)
    for _ in range(80):
        n = rng.randint(1, 8)
        c = [rng.uniform(-2, 2) for _ in range(n)]
        e = [(a, b, rng.random() * 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        value = lambda x: sum(abs(v) for v, k in zip(c, x) if v and (v > 0) != k) + sum(w for u, v, w in e if x[u] != x[v])
        best = min(map(value, itertools.product([False, True], repeat=n)))
        assert abs(value(htmltext.min_cut(c, e)) - best) < 1e-9 and abs(value(htmltext.label(c, e)) - best) < 1e-9


def test_main_text():
    page = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies.</div><nav><a href=x>Home</a></nav><main><h2>Title</h2>
    <div class="post-content"><p>Hello &lt;world&gt; <a href=x>link</a> text that is fine.<p>More &amp; more.</div><section id="comments"><p>I like this very much.</p></section><form>Name</form></main><footer>&copy; 2020</footer>"""
    assert htmltext.main_text(page) == "Title\n\nHello <world> link text that is fine.\n\nMore & more."
    assert htmltext.main_text(None) == htmltext.main_text("") == "" and htmltext.main_text("plain text") == "plain text"
    assert htmltext.main_text("<p>" + "<b>x " * 5000).count("x") == 5000


def test_main_text_drops_nothing_else(spark):
    assert htmltext.main_text("<article><p>Value <math><mi>x</mi><annotation>tex</annotation></math> and <svg viewBox='0'/> more.</p><p>Second.</p></article>") == "Value x and more.\n\nSecond."
    assert htmltext.main_text("<article><p>One.<template><p>Two.</article>") == "One.\n\nTwo."
    assert htmltext.main_text("<article>" + "<div>" * 3000 + "<p>deep one<p>deep two" + "</div>" * 3000 + "<p>after") == "deep one\n\ndeep two\n\nafter"
    assert htmltext.main_text("<p>" + " ".join(["<i>a"] * 12) + "<p>end of it.") == " ".join("a" * 12) + "\n\nend of it."


def test_html_pages(spark, tmp_path):
    pages = [(1, "u", None, 5), (2, None, "", 5), (2, None, "<p>Same text here.", 5), (None, "u", "<p>Same text here.", 5), (3, "l", "<p>long one. " * 20000, 5)]
    spark.createDataFrame(pages, "page_id long, url string, html string, n_chars int").write.parquet(str(tmp_path / "pages.parquet"))
    out = {(r["page_id"], r["url"], r["text"][:20], r["n_chars"]) for r in htmltext.op7_min_cut_html(spark, str(tmp_path)).collect()}
    long = "\n\n".join(["long one."] * 20000)
    assert out == {(1, "u", "", 0), (2, None, "", 0), (2, None, "Same text here.", 15), (None, "u", "Same text here.", 15), (3, "l", long[:20], len(long))}
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert htmltext.op7_min_cut_html(spark, str(tmp_path / "none")).count() == 0


# 8
def test_ppm_code_lengths_and_prediction(spark):
    t = langid.Tree(*langid.counted(b"abracadabra"))
    # after "\n\n\n" only "a" came: 1 of 1 + 1
    assert t.bits(langid.grams(b"a"))[0] == pytest.approx(1.0)
    # "z" never came: three escapes from known contexts "\n\n\n", then "\n\n", "\n", the empty one, and a uniform byte
    assert t.bits(langid.grams(b"z"))[0] == pytest.approx(3 - np.log2(5 / 16) + 8)
    rng = random.Random(1)
    say = {"xx": lambda: "".join(rng.choice(["tor", "mil ", "sa"]) for _ in range(30)), "yy": lambda: "".join(rng.choice(["que", "ñan ", "lo"]) for _ in range(30))}
    rows = [(i, say[k](), k) for i in range(60) for k in ["xx" if i % 2 else "yy"]]
    d = spark.createDataFrame(rows + [(100, None, "xx"), (101, "123", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["_lang"] for r in langid.identify(d, langid.fit(d)).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    assert langid.identify(edge(spark), langid.fit(edge(spark).limit(0))).count() == 8


# 9
def test_kneser_ney_sums_to_one(spark, corpus):
    m = kneserney.fit(make(spark, corpus))
    h = kneserney._Hashes()
    words = {w for _, t in corpus for w in t.encode().lower().split()}
    for start in (b"", b"ka ", b"unseen "):
        p = []
        for w in [*words, b"never", None]:
            x = kneserney.tokens(start + (w or b""), h)
            whole = m.score([x if w is None else x[:-1]])[0][3]
            before = m.score([kneserney.tokens(start, h)[:-1]])[0][3] if start else 0.0
            p.append(10 ** (whole - before))
        assert sum(p) == pytest.approx(1.0, abs=1e-6)
    r = {x["doc_id"]: x for x in kneserney.score(edge(spark), m).collect()}
    assert len(r) == 7 and r[1]["n_tokens"] == r[2]["n_tokens"] == 1
    assert kneserney.score(edge(spark), kneserney.fit(edge(spark).limit(0))).count() == 8


def brute_kneser_ney(train, order, text):
    """log10 of the text's probability by the definition, with counts in dictionaries."""
    pad = lambda t: ["<s>"] * (order - 1) + t.lower().split() + ["</s>"]
    top = collections.Counter(tuple(w[i : i + order]) for w in map(pad, train) for i in range(len(w) - order + 1))
    level = {order: top}
    for k in range(order - 1, 0, -1):
        level[k] = collections.Counter(g[1:] for g in level[k + 1])
    d = {k: [0.0, *kneserney.discounts(*(sum(n == i for n in c.values()) for i in (1, 2, 3, 4)))] for k, c in level.items()}
    vocabulary = len({w for t in train for w in t.lower().split()} | {"</s>"})

    def p(g):
        if not g:
            return 1 / (vocabulary + 1)
        k = len(g)
        alike = [n for h, n in level[k].items() if h[:-1] == g[:-1]]
        if not alike:
            return p(g[1:])
        n = level[k][g]
        return (max(n - d[k][min(n, 3)], 0) + sum(d[k][min(x, 3)] for x in alike) * p(g[1:])) / sum(alike)

    w = pad(text)
    return sum(np.log10(p(tuple(w[i : i + order]))) for i in range(len(w) - order + 1))


def test_kneser_ney_has_higher_orders(spark, corpus):
    train, h = [t for _, t in corpus[:40]], kneserney._Hashes()
    asked = [train[0], " ".join(train[1].split()[3:12]), "ka never ka", ""]
    for order in (2, 3, 4):
        m = kneserney.fit(make(spark, corpus[:40]), order)
        got = [x[3] for x in m.score([kneserney.tokens(t.encode(), h) for t in asked])]
        assert got == pytest.approx([brute_kneser_ney(train, order, t) for t in asked], abs=1e-8)
    assert kneserney.fit(make(spark, corpus[:5])).order == 3


def test_kneser_ney_base_scores_and_missing_files(spark, corpus):
    train, every = corpus[:40], corpus + [(900, "Ka\x0bNEVER ka"), (901, None), (901, "")]
    m = kneserney.fit(make(spark, train))
    c = collections.Counter(w for _, t in train for w in [*t.lower().split(), None])
    n, v = sum(c.values()), len(c)
    got = {(r["doc_id"], r["n_tokens"]): r for r in kneserney.score(make(spark, every), m).collect()}
    for i, t in every:
        w = [*(t or "").lower().split(), None]
        r = got[i, len(w)]
        assert r["n_known"] == sum(c[x] > 0 for x in w) and m.n == n
        assert r["base_score"] == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), abs=1e-9)
    gone = kneserney.Model(m.folder + "-gone", m.order, m.buckets, m.n, m.v, {k: tuple(x[1:]) for k, x in m.d.items()}, (m.before, 1, 1, 1))
    with pytest.raises(Exception):
        kneserney.score(make(spark, train), gone).collect()


def test_kneser_ney_counts_by_rounds_and_shares_common_contexts(spark, corpus, monkeypatch):
    monkeypatch.setattr(kneserney, "ROWS_PER_BUCKET", 40)  # many buckets, and common words whose contexts lie in several
    train, h = [t for _, t in corpus[:40]], kneserney._Hashes()
    asked = [train[0], " ".join(train[1].split()[3:12]), "ka never ka", ""]
    for order in (1, 2, 3, 4):
        m = kneserney.fit(make(spark, corpus[:40]), order)
        assert len(m.places.words) > 1 and m.places.parts.max() > 1
        got = [x[3] for x in m.score([kneserney.tokens(t.encode(), h) for t in asked])]
        assert got == pytest.approx([brute_kneser_ney(train, order, t) for t in asked], abs=1e-8)


def test_kneser_ney_of_known_texts_keeps_what_they_need(spark, corpus, monkeypatch):
    monkeypatch.setattr(kneserney, "ROWS_PER_BUCKET", 200)
    rows = corpus[:40] + [(900, " ".join(corpus[50][1].split()[:9]) + " ka NEVER"), (901, None), (902, corpus[3][1])]
    d, held = make(spark, rows), F.col("doc_id") % 5 == 2
    lean, whole = kneserney.fit(d, held=held), kneserney.fit(d.where(~held))
    a, b = ({r["doc_id"]: tuple(r) for r in x.collect()} for x in (kneserney.score(d, lean, held), kneserney.score(d, whole)))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)
    size = lambda m: sum(os.path.getsize(f) for f in glob.glob(kneserney.local_path(m.folder) + "/*"))
    assert size(lean) < size(whole)
    with pytest.raises(ValueError):
        kneserney.score(d, lean)


def test_words_hash_alike_in_bulk_and_alone():
    rng = random.Random(9)
    from tessera.llm.wordhash import Words

    for _ in range(60):
        texts = ["".join(rng.choice("ab \n\t\x0b\x0cé  cdefghijklmnop漢\r\xa0") for _ in range(rng.choice([0, 1, 2, 30, 200]))).encode() for _ in range(rng.randint(1, 6))]
        x = Words(np.frombuffer(b"".join(t + b"\n" for t in texts), dtype=np.uint8), np.cumsum([len(t) + 1 for t in texts]) - 1)
        words = [w for t in texts for w in t.split()]
        seen = dict(zip(words, x.hash.tolist()))
        assert len(words) == len(x.hash) and [seen[w] for w in words] == x.hash.tolist() and len(set(seen.values())) == len(seen)
        assert x.counts().tolist() == [len(t.split()) for t in texts]


# 10
def test_plan_equals_one_by_one():
    rng = random.Random(6)
    for _ in range(60):
        cap = rng.randint(3, 40)
        sizes = sorted((rng.randint(1, cap) for _ in range(rng.randint(0, 60))), reverse=True)
        bins = []
        for s in sizes:
            fit = [b for b in bins if b >= s]
            if fit:
                bins.remove(min(fit))
                bins.append(min(fit) - s)
            else:
                bins.append(cap - s)
        rows = packing.plan(dict(collections.Counter(sizes)), cap)
        used = collections.defaultdict(list)
        for length, a, b, first, offset in rows:
            for k in range(b - a):
                used[first + k].append((offset, length))
        assert sorted(cap - sum(n for _, n in v) for v in used.values()) == sorted(bins)
        for v in used.values():
            at = 0
            for offset, n in sorted(v):
                assert offset == at
                at += n


def test_packing_round_trip(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = corpus + [(900, "a<|endoftext|>b  \n\n  c"), (901, None), (902, " ".join(f"n{i}" for i in range(3000)))]
    out = packing.pack(make(spark, texts), capacity=256, with_ids=True).collect()
    seqs, docs = collections.defaultdict(dict), collections.defaultdict(dict)
    for r in out:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        seqs[r["sequence_id"]][r["offset"]] = r["length"]
        docs[r["doc_id"]][r["start"]] = r["ids"]
    for s in seqs.values():
        assert sum(s.values()) <= 256 and sorted(s) == [sum(v for k, v in s.items() if k < o) for o in sorted(s)]
    for i, t in texts:
        ids = [x for k in sorted(docs[i]) for x in docs[i][k]]
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 0]
    assert packing.pack(edge(spark).limit(0)).count() == 0 and packing.pack(edge(spark)).where("piece = 0").count() == 8


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = out
    assert 0 < docs.count() < 200
    assert corpus_pipeline.run(spark, d).agg(F.max("length")).first()[0] <= packing.CAPACITY
