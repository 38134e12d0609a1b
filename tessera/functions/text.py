"""Column functions on text: JVM-side expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stand-in token counter: runs of letters and digits, and single other visible characters.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}]"
#: Discourse words that carry no content (fixed values).
FILLER = (
    "actually", "basically", "certainly", "essentially", "generally", "however", "indeed", "moreover", "nevertheless", "particularly",
    "perhaps", "quite", "rather", "really", "relatively", "significantly", "simply", "specifically", "substantially", "therefore",
    "thus", "typically", "usually", "very", "furthermore", "additionally", "accordingly", "consequently", "notably",
)
#: Words beside which nothing is removed (fixed values).
NEGATIONS = ("no", "not", "never", "none", "nor", "neither", "without", "cannot", "except", "unless", "excluding", "less", "fewer", "non", "un", "any")


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def terms(text: Column) -> Column:
    """Lexical terms: runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def squash(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    one = F.regexp_replace(text, r"[\s\p{Z}]+", " ")
    return F.lower(F.trim(one))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def shorten(text: Column, most: int, keep: int, mark: str = "...") -> Column:
    """Texts of `most` characters or more as their first `keep` and the mark."""
    return F.when(F.length(text) >= most, F.concat(F.substring(text, 1, keep), F.lit(mark))).otherwise(text)


def has_word(text: Column) -> Column:
    return text.rlike("[A-Za-z]{2,}")


def informative_short(text: Column) -> Column:
    """Whether a short line states something: a word with a number, or with a capitalised word after the first."""
    return has_word(text) & (text.rlike(r"\p{Nd}") | text.rlike(r"(?s)\S+\s+.*\b[A-Z][a-zA-Z]{2,}"))


def strip_filler(text: Column, legacy: bool = False) -> Column:
    """text without filler words, unless a neighbouring word has a digit or is a negation; white space runs then become one space.
    Neighbours are the nearest words; with legacy only those of letters alone, so that no digit is ever seen."""
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    alpha = lambda p: p.rlike(r"^\p{L}+$")
    word = alpha if legacy else (lambda p: p.rlike(r"^[\p{L}\p{N}_]"))

    def body(parts: Column) -> Column:
        at = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: word(x["p"]))

        def guarded(x: Column) -> Column:
            return F.coalesce(x["p"].rlike(r"\p{Nd}") | F.lower(x["p"]).isin(*NEGATIONS), F.lit(False))

        def with_words(at: Column) -> Column:
            def gone(x: Column, k: Column) -> Column:
                before = F.when(k > 0, guarded(F.try_element_at(at, k))).otherwise(False)
                return alpha(x["p"]) & F.lower(x["p"]).isin(*FILLER) & ~before & ~guarded(F.try_element_at(at, k + 2))

            def without(drop: Column) -> Column:
                left = F.array_join(F.filter(parts, lambda p, i: ~F.array_contains(drop, i)), "")
                tidy = F.regexp_replace(F.regexp_replace(left, r"[\s\p{Z}]{2,}", " "), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
                return F.when(F.size(drop) > 0, tidy).otherwise(text)

            return F.transform(F.array(F.transform(F.filter(at, gone), lambda x: x["i"])), without)[0]

        return F.transform(F.array(at), with_words)[0]

    return F.transform(F.array(parts), body)[0]


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits as DuckDB rounds: the nearest whole number of x times the power of ten, halves away from zero. Spark's round
    takes the decimal that x prints as, so that 133.0332695, times a million less than a half in floating point, goes up."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def cost(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    """USD for token counts and prices a million; null if a count is."""
    return (prompt * price_in + completion * price_out) / 1e6


def cache_key(*parts: Column) -> Column:
    """The score cache's key: a digest of the parts, each followed by a zero character."""
    return F.concat(F.lit("s:"), F.sha2(F.concat(*(x for p in parts for x in (p, F.lit("\0")))), 256))


def source_id(doc: Column, chunk: Column) -> Column:
    return F.concat(doc, F.lit("#"), chunk.cast("string"))


def prompt(nonce: Column, context: Column, question: Column) -> Column:
    return F.concat(nonce, F.lit("\n\nCONTEXT\n"), context, F.lit("\n\nQUESTION\n"), question)


def tickers(text: Column) -> Column:
    """A comma-separated list, trimmed and in upper case, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
