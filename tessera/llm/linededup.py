"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity, rarest first; by the prefix filter, lines of Jaccard similarity 0.8 share
m words among the first n - ceil(0.8 n) + m, which makes words of these prefixes the join key; m grows with the line. Length and
position filters thin the candidates, and so does a 128 bit parity sketch: sets differ in at least as many words as their sketches
in bits. The full sets verify what is left. Equal sets collapse first. A line goes when an earlier one (by doc_id and place in the
text) is similar to it.

Before the join over all prefixes, lines under a word that is among the rarest of more than CROWD lines are compared with the
earliest of these. Under words where this settles many, the open lines are compared with the earliest open one, and so on. Settled
lines look for no earlier ones any more, but later open lines still meet them, so that a crowd of near copies costs few pairs a line.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, Scratch, checkpoint, fits, let, release, spare, table, typed

#: Lines with fewer distinct words take no part: only lines without any word.
MIN_TOKENS = 1
#: Smaller sets are similar to equal ones only (3 of 4 words are 0.75), which collapse by their hash and need no join.
JOIN_TOKENS = 4
#: Counters of the word order, a byte each: a word's rarity is the count of its bucket, over all words of the corpus.
BUCKETS = 1 << 18
#: Levels of rarity in a doubling of the count.
STEPS = 4
#: Lines of more words have a sketch of 128 bits, others of 64.
LONG = 64
#: More lines than this under a word that is among their so many rarest are a crowd.
CROWD, CROWD_WORDS = 16, 4
#: Rounds over near copies go on while they settle one in so many of the lines left.
ROUND = 20
#: Bits of the filters, at most.
MAX_BITS = 1 << 26
#: Bits of a word's hash beside its rarity.
HASH_BITS = 56
SPACE = r"[\x20\x09-\x0D]+"
PLACE = ["doc_id", "line"]


def _split(line: Column) -> Column:
    """The line's words, and empty strings. Few lines have another white space than spaces, at which no pattern is needed to split."""
    other = line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    return F.when(other, F.split(line, SPACE)).otherwise(F.split(line, " "))


def _hashes(line: Column) -> Column:
    """The 64 bit hashes of the line's distinct words."""
    return F.array_distinct(F.transform(F.array_remove(_split(line), ""), lambda w: F.xxhash64(w)))


def _levels(docs: DataFrame) -> Column:
    """The rarity of every word: the level of its bucket's count, 0 (a single word) to 127, as a literal of one byte a bucket."""
    w = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(_split(F.col("line"))).alias("w"))
    n = w.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("i")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(127), F.floor(STEPS * F.log2("n"))).cast("long")
    place = lambda x: F.call_function("shiftleft", x, (8 * (F.col("i") % 8)).cast("int"))
    eight = n.groupBy(F.floor(F.col("i") / 8).cast("int").alias("j")).agg(F.bit_or(place(level)).alias("v"))
    part = eight.groupBy(F.floor(F.col("j") / 512).alias("c")).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("x"))
    out = bytearray(BUCKETS)
    for js, vs in part.select("x.j", "x.v").collect():  # BUCKETS / 8 numbers at most
        for j, v in zip(js, vs):
            out[8 * j : 8 * j + 8] = v.to_bytes(8, "little")
    return F.lit(bytes(out))


def _token(h: Column, levels: Column) -> Column:
    """A word as a number that orders words by rarity: level, then hash."""
    at = h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1
    level = F.ascii(F.substring(levels, at, 1).cast("string")).cast("long")
    return F.shiftleft(level, HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(PLACE, name) with value worked out once a row. Spark compiles no expression around or below a lambda: what can be compiled goes
    into steps of its own."""
    return rows.select(*PLACE, F.explode(F.array(value)).alias(name))


def _lines(docs: DataFrame, levels: Column) -> DataFrame:
    """For each line with a word: its place, n (distinct words), h and g (128 bit hash of the set), sk and sl (the sketch), skipped (words
    of the prefix that occur once in the corpus and so join nothing) and pre (the rest of the prefix)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    words = _once(lines, F.array_remove(_split(F.col("text")), ""), "w").where(F.size("w") >= MIN_TOKENS)
    hashes = _once(words, F.transform("w", lambda w: F.xxhash64(w)), "t")
    tokens = _once(_once(hashes, F.array_distinct("t"), "t"), F.transform("t", lambda h: _token(h, levels)), "t")
    t = _once(tokens, F.sort_array("t"), "t")
    n = F.size("t")
    length = F.when(n >= JOIN_TOKENS, n - F.floor((4 * n + 4) / 5) + _shared(n)).otherwise(0).cast("int")
    prefix = F.slice("t", F.lit(1), length)
    often = F.when(F.shiftright(F.get("t", F.lit(0)), HASH_BITS) > 0, prefix).otherwise(F.filter(prefix, lambda x: F.shiftright(x, HASH_BITS) > 0))
    x = t.select(*PLACE, n.alias("n"), F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g"), _sketch(F.col("t")).alias("sk"), F.when(n > LONG, _sketch(F.col("t"), True)).otherwise(0).alias("sl"), length.alias("length"), often.alias("pre"))
    return x.select(*PLACE, "n", "h", "g", "sk", "sl", (F.col("length") - F.size("pre")).alias("skipped"), "pre")


def _short_prefix(n: Column) -> Column:
    """n - ceil(8 n / 9) + m: enough for the smaller set of a pair when the larger one has its full prefix."""
    return n - F.floor((8 * n + 8) / 9) + _shared(n)


def _shared(n: Column) -> Column:
    """m: words that the prefixes of two similar sets share, at least, the smaller set's m holding for a pair."""
    return F.floor(n / 40) + 1


def _sketch(t: Column, half: bool = False) -> Column:
    """For each of 64 places the parity of the words that fall there; half: of one half of the words."""

    def bit(x: Column) -> Column:
        one = F.shiftright(x, 30).bitwiseAND(F.lit(1).cast("long")) if half else F.lit(1).cast("long")
        return F.call_function("shiftleft", one, F.shiftright(x, 24).bitwiseAND(F.lit(63).cast("long")).cast("int"))

    return F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x)))


def _close(na: Column, nb: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The length filter, and that of the sketches: |x - y| + |y - x| <= (na + nb) / 9 when the similarity is 0.8 or more. In long lines
    either half of the words has a sketch of its own: sl, and that of all without it."""
    every, one = a[0].bitwiseXOR(b[0]), a[1].bitwiseXOR(b[1])
    apart = F.when(F.least(na, nb) > LONG, F.bit_count(every.bitwiseXOR(one)) + F.bit_count(one)).otherwise(F.bit_count(every))
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * apart <= na + nb)


class _Filter:
    """A bit set over the hashes of some keys, which lets through every one of them and few others: a scalar array of 64 bit numbers,
    MAX_BITS / 64 at most."""

    def __init__(self, keys: DataFrame):
        self.keys, self.bits = keys.columns, 1 << 16
        n = keys.count()
        while self.bits < min(MAX_BITS, 16 * n):
            self.bits *= 2
        h = F.pmod(F.xxhash64(*self.keys), F.lit(self.bits))
        parts = keys.select(F.floor(h / 64).alias("i"), self._bit(h).alias("v"))
        every = parts.union(keys.sparkSession.range(self.bits // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("v")))
        rows = every.groupBy("i").agg(F.bit_or("v").alias("v"))
        self.array = checkpoint(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("a")))

    @staticmethod
    def _bit(h: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))

    def __call__(self) -> Column:
        h = F.pmod(F.xxhash64(*self.keys), F.lit(self.bits))
        return F.element_at(self.array.scalar(), (F.floor(h / 64) + 1).cast("int")).bitwiseAND(self._bit(h)) != 0


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows whose place is not in gone. Where gone is large, only rows that a filter cannot clear are shuffled."""
    if fits(gone):
        return rows.join(F.broadcast(gone), PLACE, "left_anti")
    maybe = _Filter(gone)
    return rows.where(~maybe()).unionByName(rows.where(maybe()).join(gone, PLACE, "left_anti"))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, line, t): the full sets of the lines named by ids, as 64 bit hashes; of a place that rows with a repeated doc_id share,
    each row's set."""
    wanted = ids.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    if fits(wanted, BROADCAST_ROWS // 2):
        some = docs.join(F.broadcast(wanted), "doc_id")
    else:
        some = docs.where(_Filter(ids.select("doc_id"))()).join(wanted, "doc_id")
    own = let(F.split("text", "\n"), lambda ls: F.transform("lines", lambda i: F.struct(i.alias("line"), F.get(ls, i).alias("text"))))
    lines = some.select("doc_id", F.explode(own).alias("x")).select("doc_id", "x.*")
    return lines.select(*PLACE, _hashes(F.col("text")).alias("t"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (da, la, db, lb) of places whose lines have a Jaccard similarity of 0.8 or more."""
    for s in "ab":
        pairs = pairs.join(sets.select(F.col("doc_id").alias(f"d{s}"), F.col("line").alias(f"l{s}"), F.col("t").alias(f"t{s}")), [f"d{s}", f"l{s}"])
    alike = 9 * F.size(F.array_intersect("ta", "tb")) >= 4 * (F.size("ta") + F.size("tb"))
    return pairs.where(alike).select("da", "la", "db", "lb").distinct()


def _places(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("da").alias("doc_id"), F.col("la").alias("line")).union(pairs.select("db", "lb")).distinct()


def _against_first(keyed: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of each crowd's earliest line with its other lines, and (k, r) with the crowd's word and that line."""
    first = keyed.groupBy("k").agg(F.min(F.struct(*PLACE, "n", "sk", "sl")).alias("r"), F.count("*").alias("c")).where(F.col("c") > CROWD).select("k", "r")
    later = (F.col("doc_id") > F.col("r.doc_id")) | ((F.col("doc_id") == F.col("r.doc_id")) & (F.col("line") > F.col("r.line")))
    sketch = lambda p: (F.col(f"{p}sk"), F.col(f"{p}sl"))
    first = tmp.save(first)
    near = keyed.join(F.broadcast(first) if fits(first) else first, "k").where(later & _close(F.col("n"), F.col("r.n"), sketch(""), sketch("r.")))
    return near.select(F.col("r.doc_id").alias("da"), F.col("r.line").alias("la"), F.col("doc_id").alias("db"), F.col("line").alias("lb")).distinct(), first


def _settled(joined: DataFrame, docs: DataFrame, tmp: Scratch) -> DataFrame:
    """Places of lines that are similar to an earlier line of a crowd that they are in, as far as rounds over crowds find them."""
    later = lambda pairs: pairs.select(F.col("db").alias("doc_id"), F.col("lb").alias("line")).distinct()
    k = F.filter(F.slice("pre", 1, CROWD_WORDS), lambda x: F.shiftright(x, HASH_BITS) >= int(STEPS * math.log2(CROWD + 1)))
    keyed = tmp.save(joined.select(*PLACE, "n", "sk", "sl", F.explode(k).alias("k")))
    many = tmp.save(keyed.groupBy("k").count().where(F.col("count") > CROWD).select("k"))
    keyed = tmp.save(keyed.join(F.broadcast(many) if fits(many) else many, "k"))
    pairs, first = _against_first(keyed, tmp)
    pairs = tmp.save(pairs)
    settled = tmp.save(later(_similar(pairs, tmp.save(_sets(docs, _places(pairs))))))
    # crowds of which many lines were settled are near copies: rounds over all lines under any word of theirs, against the earliest line,
    # then against the earliest open one, and so on
    near = joined.join(F.broadcast(settled) if fits(settled) else settled, PLACE, "left_semi")
    proven = tmp.save(near.select(F.explode("pre").alias("k")).groupBy("k").count().where(F.col("count") > CROWD).select("k"))
    rest = joined.select(*PLACE, "n", "sk", "sl", F.explode("pre").alias("k"))
    rest = tmp.save(rest.join(F.broadcast(proven) if fits(proven) else proven, "k", "left_semi"))
    sets, n = None, rest.select(*PLACE).distinct().count()
    while n:
        sets = sets or tmp.save(_sets(docs, rest.select(*PLACE).distinct()))
        pairs, first = _against_first(rest, tmp)
        done = settled.select(F.col("doc_id").alias("db"), F.col("line").alias("lb"))
        more = tmp.save(later(_similar(pairs.join(F.broadcast(done) if fits(done) else done, ["db", "lb"], "left_anti"), sets)))
        found = more.count()
        settled = tmp.save(settled.union(more))
        if ROUND * found < n:  # the join sees to the rest
            break
        pivots = first.select("k", F.col("r.doc_id").alias("doc_id"), F.col("r.line").alias("line"))
        rest = tmp.save(_without(rest, settled).join(pivots, ["k", *PLACE], "left_anti"))
        n = rest.select(*PLACE).distinct().count()
    return tmp.save(settled.distinct())


def _joined(x: DataFrame, y: DataFrame) -> DataFrame:
    """A row (da, la, db, lb, m) for each word under which a line of x and a later one of y pass the prefix, length, position and sketch
    filters. m: words that must be shared."""
    a, b = (e.select("k", F.col("doc_id").alias(f"d{s}"), F.col("line").alias(f"l{s}"), F.col("i").alias(f"i{s}"), F.col("sk").alias(f"s{s}"), F.col("sl").alias(f"t{s}")) for s, e in (("a", x), ("b", y)))
    na, nb = (F.shiftright(F.col(f"i{s}"), 32) for s in "ab")
    pa, pb = (F.col(f"i{s}").bitwiseAND(F.lit(0xFFFFFFFF)) for s in "ab")
    bound = F.least(pa, pb) + 1 + F.least(na - pa - 1, nb - pb - 1)
    ok = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("la") < F.col("lb")))
    ok = ok & (9 * bound >= 4 * (na + nb)) & _close(na, nb, (F.col("sa"), F.col("ta")), (F.col("sb"), F.col("tb")))
    ok = ok & F.when(na <= nb, pa < _short_prefix(na)).otherwise(pb < _short_prefix(nb))
    some = (F.broadcast(a) if x is not y and fits(x) else a).join(b, "k").where(ok)
    return some.select("da", "la", "db", "lb", _shared(F.least(na, nb)).alias("m"))


def _candidates(joined: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs (da, la, db, lb) of a line and a later open one that pass all filters, with the number of shared words of the prefixes."""
    i = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("skipped") + F.col("pos")).cast("long"))  # n and the position in one number
    keyed = lambda x: x.select(*PLACE, "n", "sk", "sl", "skipped", F.posexplode("pre").alias("pos", "k")).select("k", *PLACE, i.alias("i"), "sk", "sl")
    unsettled = keyed(_without(joined, settled))
    closed = keyed(joined.join(F.broadcast(settled) if fits(settled) else settled, PLACE, "left_semi"))
    some = _joined(unsettled, unsettled).union(_joined(closed, unsettled))
    return some.groupBy("da", "la", "db", "lb", "m").count().where("count >= m").select("da", "la", "db", "lb", "count")


def _found(pairs: DataFrame, docs: DataFrame, tmp: Scratch) -> DataFrame:
    """Places of later lines of the candidate pairs that are similar. Each line's pair of the most shared words is verified first, so
    that of lines with many similar ones few pairs are."""
    later = lambda x: x.select(F.col("db").alias("doc_id"), F.col("lb").alias("line")).distinct()
    best = tmp.save(pairs.groupBy("db", "lb").agg(F.max(F.struct("count", "da", "la")).alias("r")).select("r.da", "r.la", "db", "lb"))
    first = tmp.save(later(_similar(best, tmp.save(_sets(docs, _places(best))))))
    rest = pairs.drop("count").join(best, ["da", "la", "db", "lb"], "left_anti")
    done = first.select(F.col("doc_id").alias("db"), F.col("line").alias("lb"))
    rest = tmp.save(rest.join(F.broadcast(done) if fits(done) else done, ["db", "lb"], "left_anti"))
    return first.union(later(_similar(rest, tmp.save(_sets(docs, _places(rest))))))


def _copies(lines: DataFrame, tmp: Scratch) -> DataFrame:
    """Places of lines (h, g, doc_id, line) that are not the earliest of their set."""
    same = tmp.save(lines.groupBy("h", "g").agg(F.min("doc_id").alias("d"), F.count("*").alias("c")).where(F.col("c") > 1).drop("c"))
    rows = tmp.save(lines.join(F.broadcast(same) if fits(same) else same, ["h", "g"]))
    first = rows.where(F.col("doc_id") == F.col("d")).groupBy("h", "g").agg(F.min("line").alias("l"))
    later = (F.col("doc_id") > F.col("d")) | (F.col("line") > F.col("l"))
    return rows.join(F.broadcast(first) if fits(same) else first, ["h", "g"]).where(later).select(*PLACE).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lines): for each document with such lines, the places (from 0) of lines to which an earlier one is similar."""
    spark = docs.sparkSession
    docs = typed(docs, "doc_id long, text string").where("doc_id is not null and text is not null")
    with Scratch(spark) as tmp:
        every = tmp.save(_lines(docs, _levels(docs)))
        # of equal sets (by 128 bits) only the earliest takes part in the join
        copies = tmp.save(_copies(every.select("h", "g", *PLACE), tmp))
        joined = tmp.save(_without(every.where(F.size("pre") > 0).drop("h", "g"), copies))
        tmp.drop(every)
        settled = _settled(joined, docs, tmp)
        pairs = tmp.save(_candidates(joined, settled))
        found = _found(pairs, docs, tmp)
        gone = checkpoint(copies.union(found).union(settled).groupBy("doc_id").agg(F.collect_set("line").alias("lines")))
    release(spark)
    return gone


def dedup_lines(docs: DataFrame, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the removed lines taken out of text; n_chars, where docs has it, follows the text. counts: names of two further
    columns, the numbers of lines and of removed ones.

    Two lines are similar when their sets of words (runs without white space, case kept) have a Jaccard similarity of 0.8 or more;
    lines without a word stay. A line goes whether the earlier one stays or not. Rows that repeat a doc_id
    share its places, and equal places are not earlier than each other. Null texts and ids stay as they are; a text may become
    empty; an empty table gives no rows. All other columns stay as they are, whatever their names.
    """
    gone, rows = spare(docs, "gone"), removed_lines(docs)
    rows = rows.withColumnRenamed("lines", gone)
    # only texts that lose lines, and few others, are shuffled
    maybe = F.coalesce(_Filter(rows.select("doc_id"))(), F.lit(False))
    x = docs.where(maybe).join(rows, "doc_id", "left").unionByName(docs.where(~maybe).withColumn(gone, F.lit(None).cast("array<int>")))
    without = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone)), lambda i: F.get(ls, i)), "\n")
    out = {"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), without))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(out["text"]).cast(kind))
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    more = [F.coalesce(c, F.lit(0)).cast("long").alias(name) for c, name in zip((ends + 1, F.size(gone)), counts or ())]
    return x.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns), *more)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    docs = typed(table(spark, sf_dir, "documents"), "doc_id long, text string")
    return dedup_lines(docs, ("n_lines", "n_removed")).select("doc_id", "n_lines", "n_removed", "text")


#: The same in DuckDB SQL: every pair of distinct sets that shares a word is counted.
ORACLE = f"""
with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) i, unnest(string_split(text, chr(10))) line from documents where doc_id is not null and text is not null),
t as (select doc_id, i, list_sort(list_distinct(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) t from l),
u as materialized (select doc_id, i, t, len(t) n from t where len(t) >= {MIN_TOKENS}),
d as materialized (select row_number() over (order by min((doc_id, i))) id, t, any_value(n) n from u group by t),
w as materialized (select id, n, unnest(t) w from d),
f as materialized (select w, row_number() over (order by count(*), w) r from w group by w),
p as materialized (select id, n, w, row_number() over (partition by id order by r) k from w join f using (w)),
q as materialized (select id, n, w from p where k <= n - ceil(0.8 * n - 1e-9) + 1),
c as materialized (select distinct a.id a, b.id b from q a join q b on a.w = b.w and a.id < b.id where 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
g as (select distinct c.b id from c join d x on x.id = c.a join d y on y.id = c.b where 9 * len(list_intersect(x.t, y.t)) >= 4 * (x.n + y.n)),
e as (select u.doc_id, u.i, d.id, g.id is not null near, (u.doc_id, u.i) > min((u.doc_id, u.i)) over (partition by d.id) later from u join d using (t) left join g on g.id = d.id),
r as (select distinct doc_id, i from e where near or later),
k as (select l.doc_id, string_agg(line, chr(10) order by l.i) filter (r.i is null) text, count(*) n, count(r.i) m from l left join r on l.doc_id = r.doc_id and l.i = r.i group by l.doc_id)
select o.doc_id, coalesce(k.n, 0)::bigint n_lines, coalesce(k.m, 0)::bigint n_removed, case when o.text is null then null when k.n is null then o.text else coalesce(k.text, '') end as text from documents o left join k on k.doc_id = o.doc_id"""
