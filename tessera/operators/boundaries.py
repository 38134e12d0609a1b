"""Where sentences end, learned from a corpus without marks: abbreviations, collocations across a full stop, words that start sentences
and words that a capital tells something about, by likelihood ratios of counts (Kiss and Strunk, 2006).

Everything is counted by aggregations that combine before they shuffle; what is left are distinct types and the distinct pairs of types
around a full stop. The result is a small table, to be kept and given to a LearnedSplitter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.splitters import CAN_END, CLOSING, END_BEFORE, NUMBER, OPENING, SPACE, STOP
from tessera.plans.lineage import cut

ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0  #: least scores of each kind, those of the paper
RATIO = 10  #: how many times more often a word must have one case than the other inside sentences to be known by it


def word_type(word: Column) -> Column:
    """The word in lower case without the punctuation around it; all numbers are the type 0; null where there is neither letter nor number."""
    bare = F.regexp_replace(F.regexp_replace(word, CLOSING, ""), OPENING, "")
    kind = lambda b: F.when(b.rlike(NUMBER), "0").when(b.rlike(r"\p{L}"), F.lower(b))
    return F.transform(F.array(bare), kind)[0]  # bound once


def _typed(words: DataFrame, word: str, name: str) -> DataFrame:
    """words that have a type, with it. A generator, as a filter on the type would work it out again."""
    return words.select("*", F.explode(F.array_compact(F.array(word_type(F.col(word))))).alias(name))


def _words(docs: DataFrame, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each word of each line with the one before it, null at a line's start: before, word. only: of which pairs (b, a)."""
    line = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    words = line.select(F.filter(F.split("line", SPACE), lambda x: x != "").alias("l"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.col("l")).alias("b"), F.col("l").alias("a"))
    x = words.where(F.size("l") > 0).select(F.explode(pairs if only is None else F.filter(pairs, only)).alias("x"))
    return x.select(F.col("x.b").alias("before"), F.col("x.a").alias("word")).where("word is not null")


def types(docs: DataFrame) -> DataFrame:
    """Of each type: w, n, n_stop (with a full stop behind it), n_lower (beginning with a small letter), n_upper (beginning with a
    capital inside a sentence, as far as can be seen)."""
    last = F.substring("before", -1, 1)
    ends = F.contains(F.lit(CAN_END), last) & F.col("before").rlike(END_BEFORE)  # most words end with a letter: no pattern is tried on them
    inside = (F.col("before").isNotNull() & ~F.coalesce(ends, F.lit(False))).alias("inside")
    forms = _words(docs).groupBy("word", inside).agg(F.count("*").alias("n"))  # spellings first: patterns see each of them once
    lower = F.regexp_replace("word", OPENING, "").rlike(r"^\p{Ll}")
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    count = [F.sum("n").alias("n"), some(F.col("word").rlike(STOP)).alias("n_stop"), some(lower).alias("n_lower"), some(F.col("inside") & F.col("word").rlike(r"^\p{Lu}")).alias("n_upper")]
    return _typed(forms, "word", "w").groupBy("w").agg(*count)


def pairs(docs: DataFrame) -> DataFrame:
    """p, w, n_pair: how often type w, with a capital or a digit first, follows type p and its full stop."""
    forms = _words(docs, lambda x: F.contains(x["b"], F.lit("."))).groupBy("before", "word").agg(F.count("*").alias("n"))
    starts = F.regexp_replace("word", OPENING, "").rlike(r"^[\p{Lu}0-9]")
    typed = _typed(_typed(forms.where(F.col("before").rlike(STOP) & starts), "before", "p"), "word", "w")
    return typed.groupBy("p", "w").agg(F.sum("n").alias("n_pair"))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Of k among n by probability p; 0 log 0 is 0."""
    return F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.ln(1 - p)).otherwise(0.0)


def abbreviation_score(n: Column, n_stop: Column, w: Column, rate: float) -> Column:
    """How much likelier the stops behind w are if it is an abbreviation (nearly always one) than at the rate of all words; less for
    long words and for each occurrence without a stop, more for stops within."""
    length = F.greatest(F.length(F.replace(w, F.lit("."), F.lit(""))), F.lit(1))
    ratio = 2 * (_log_likelihood(n_stop, n, F.lit(0.99)) - _log_likelihood(n_stop, n, F.lit(rate)))
    inner = 1 + F.length(w) - F.length(F.replace(w, F.lit("."), F.lit("")))
    return ratio * F.exp(-length) * inner * F.pow(length.cast("double"), -(n - n_stop))


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Likelihood ratio of b's occurring as often after a as elsewhere: a, b and both are counts among n."""
    p, after, elsewhere = b / n, both / a, (b - both) / F.nullif(n - a, F.lit(0.0))
    apart = _log_likelihood(both, a, after) + _log_likelihood(b - both, n - a, elsewhere)
    return 2 * (apart - _log_likelihood(both, a, p) - _log_likelihood(b - both, n - a, p))


def learn(docs: DataFrame, least: int = 5) -> DataFrame:
    """kind, word, next, n, score of all that tells of sentence ends in docs (text), for things seen at least so often:

    abbreviation  word is one
    starter       word begins sentences more often than chance has it
    collocation   next follows word and its full stop more often than chance has it, and is no starter
    common        word is small inside sentences, so that with a capital it begins one
    proper        word has its capital inside sentences too

    The last two only of words that follow the stop of an abbreviation, a single letter or a number. Null and empty texts count
    nothing; repeated rows count as often; a docs without words gives an empty table."""
    t = cut(types(docs))
    n, stops = t.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_stop"), F.lit(0))).first()
    scored = t.where((F.col("n") >= least) & (F.col("n_stop") > 0) & (F.col("w") != "0"))
    rate = min(max(stops / n, 1e-12), 1 - 1e-12) if n else 0.5
    scored = scored.withColumn("score", abbreviation_score(F.col("n"), F.col("n_stop"), F.col("w"), rate)).where(F.col("score") >= ABBREVIATION)
    abbreviations = cut(scored.select("w", "n_stop", "score"))

    known = abbreviations.select(F.col("w").alias("p"), F.lit(True).alias("abbreviation"))
    special = F.coalesce("abbreviation", F.lit(False)) | (F.col("p") == "0") | (F.length("p") == 1)
    around = cut(pairs(docs).join(known, "p", "left").select("p", "w", "n_pair", special.alias("special")))

    total, x = F.lit(float(n)), {c: F.col(c).cast("double") for c in ("n", "n_stop", "n_pair", "after")}
    breaks = around.where("not special").agg(F.coalesce(F.sum("n_pair"), F.lit(0)).cast("double")).first()[0]
    firsts = around.where("not special").groupBy("w").agg(F.sum("n_pair").alias("after")).where(F.col("after") >= least).join(t, "w")
    starters = firsts.where((F.lit(breaks) > 0) & (x["after"] * total > x["n"] * breaks)).withColumn("score", association(F.lit(breaks), x["n"], x["after"], total))
    starters = cut(starters.where(F.col("score") >= STARTER).select("w", "after", "score"))

    specials = around.where("special")
    joined = specials.where(F.col("n_pair") >= least).join(t.select("w", "n"), "w").join(t.select(F.col("w").alias("p"), "n_stop"), "p").join(starters.select("w"), "w", "left_anti")
    joined = joined.where(x["n_pair"] * total > x["n_stop"] * x["n"]).withColumn("score", association(x["n_stop"], x["n"], x["n_pair"], total))
    cased = specials.groupBy("w").agg(F.sum("n_pair").alias("after")).where((F.col("after") >= least) & (F.col("w") != "0")).join(t, "w")

    none = F.lit(None)
    parts = [
        abbreviations.select(F.lit("abbreviation"), "w", none.cast("string"), "n_stop", "score"),
        starters.select(F.lit("starter"), "w", none.cast("string"), "after", "score"),
        joined.where(F.col("score") >= COLLOCATION).select(F.lit("collocation"), "p", "w", "n_pair", "score"),
        cased.where((F.col("n_lower") > 0) & (F.col("n_upper") * RATIO <= F.col("n_lower"))).select(F.lit("common"), "w", none.cast("string"), "n_lower", none.cast("double")),
        cased.where((F.col("n_upper") > 0) & (F.col("n_lower") * RATIO <= F.col("n_upper"))).select(F.lit("proper"), "w", none.cast("string"), "n_upper", none.cast("double")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.toDF("kind", "word", "next", "n", "score")
