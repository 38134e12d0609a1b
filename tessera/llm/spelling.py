"""Spelling variants: words one edit apart, found by a rare-first prefix filter on bigrams, grouped under their commonest form.

An edit of one code point changes at most two bigrams of either word. So when both words' bigrams are put in one global order, rarest
first, the first unchanged one is among the first three of both: joining those three loses no pair. It also stands at the same place
in words of one length, and at the same or the next place in a word that is one longer, so place and length are in the join's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, typed

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many runs, chosen by its hash, loses a letter.
NOISE = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Bigrams that an edit can change, and one.
PREFIX = 3


def runs(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH) -> DataFrame:
    """word: each run of letters of every text that has min_length code points, lower-cased; where `noise` divides the run's hash it
    has lost a letter before it is measured."""
    r = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    # a run under min_length never counts, as it can only lose letters
    r = r.where(F.length("run") >= min_length).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    r = r.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return r.select(F.when(F.col("h") % noise == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)


def word_counts(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: how often each word occurs in all texts, for words of min_count occurrences."""
    return runs(docs, noise, min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def bigrams(word: Column) -> Column:
    """(gram, place) of every two neighbouring code points, place from 1."""
    places = F.sequence(F.lit(1), F.length(word) - 1)
    return F.transform(places, lambda i: F.struct(F.substring(word, i, F.lit(2)).alias("gram"), i.alias("place")))


def prefixes(words: DataFrame) -> DataFrame:
    """word, n, size, gram, place: the three rarest bigrams of each word, by the number of words' bigrams that are the same, then by
    the bigram and its place. Bigrams number at most the square of the alphabet (90 letters), so their order fits a broadcast."""
    g = words.select("word", "n", F.length("word").alias("size"), F.explode(bigrams(F.col("word"))).alias("b")).select("word", "n", "size", "b.gram", "b.place")
    order = g.groupBy("gram").agg(F.count("*").alias("often"))
    first = g.join(F.broadcast(order), "gram").groupBy("word", "n", "size").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "place"))).alias("all"))
    return first.select("word", "n", "size", F.explode(F.slice("all", 1, PREFIX)).alias("p")).select("word", "n", "size", "p.gram", "p.place")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: the pairs of words at one insertion, deletion or replacement, each once, the shorter (or lesser) first."""
    p = prefixes(words)
    left = p.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "gram", "place", "size")
    # a word looks for those of its own length at the same place, and for those one shorter at the same or the place before
    at = lambda back, shorter: F.struct((F.col("place") - back).alias("place"), (F.col("size") - shorter).alias("size"))
    probe = F.array(at(0, 0), at(0, 1), at(1, 1))
    right = p.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"), "gram", F.explode(probe).alias("at"))
    right = right.select("b", "n_b", "size_b", "gram", F.col("at.place").alias("place"), F.col("at.size").alias("size"))
    pairs = left.join(right, ["gram", "place", "size"]).where((F.col("size") < F.col("size_b")) | (F.col("a") < F.col("b")))
    near = pairs.where(F.levenshtein("a", "b", 1) == 1)
    return near.select("a", "n_a", "b", "n_b").distinct()


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n), which must be distinct and of four code points or more: a shorter
    word has too few bigrams for the filter.

    A word's form is its near word of largest n (ties: the smallest in code-point order) where that n is at least `ratio` times its
    own, else null; root is the end of the chain of forms, or the word itself. ratio must be over 1, so that chains rise and end. A
    word without near words has n_near 0. An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = checkpoint(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
    j = words.join(best, "word", "left")
    has = -F.col("best.m") >= ratio * F.col("n")
    forms = checkpoint(j.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")))
    linked = forms.where("form is not null").select("word", F.col("form").alias("root"))
    return forms.join(_roots(linked), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, root for links that rise: each round replaces a root by its own root, so that the way covered doubles."""
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        step = checkpoint(links.join(up, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """The words of all texts of docs (doc_id, text), grouped as by group().

    A null text has no words, a null doc_id counts as an empty one in the hash; repeated rows count as often as they come; texts of
    any length are taken whole; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    if min_length < 4:
        raise ValueError("the filter needs words of four code points or more")
    return group(word_counts(typed(docs, "doc_id long, text string"), noise, min_length, min_count), ratio)


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
