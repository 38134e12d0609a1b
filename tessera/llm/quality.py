"""Robust multivariate outliers of text statistics by minimum-covariance-determinant estimates.

Four statistics of a text are transformed and, for each language and source, their centre and covariance are estimated from the three
quarters of rows that make the determinant small: concentration steps from two deterministic starts (all rows; medians and quartiles
of each coordinate), of which the smaller determinant wins. A row is rejected when its squared Mahalanobis distance exceeds a
chi-square quantile. Everything is DataFrame expressions. A concentration step is one pass: rows are summed by the bin of their
distance, and the bins below the one that completes the wanted share give the next centre and covariance, so that a group of any
size is summed where its rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.common import checked_join, checkpoint, let, table, typed, words

#: Least spread of each transformed statistic (added to the covariance), share of rows in the estimate, its consistency factor for
#: four dimensions, the 0.999 quantile of chi-square with four degrees, concentration steps, rows that a group of its own needs.
FLOORS = (0.06, 0.5, 0.25, 0.25)
SHARE, CONSISTENCY, CUTOFF, STEPS, MIN_ROWS = 0.75, 1.4862, 18.467, 4, 50
#: Bins of the squared distance per octave, and of a coordinate per unit.
OCTAVE, GRID = 16, 256
P = 4
Z = [f"z{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
GROUP = ["_lang", "_source"]


def counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _n_lines. The trigrams of a text are
    held as 64 bit hashes inside its row; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2))))

    def same(s: Column, x: Column, j: Column) -> Column:
        """Whether entry j (from 0) of the sorted array s has a neighbour with its hash."""
        before = F.when(j > 0, F.try_element_at(s, j)["h"] == x["h"])
        after = F.try_element_at(s, j + 2)["h"] == x["h"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    def covered(g: Column) -> Column:
        s = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(s, lambda s: F.filter(s, lambda x, j: same(s, x, j)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    d = docs.withColumn("_w", words(F.col("text"))).withColumn("_g", grams).withColumn("_l", lines)
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"))
    d = d.withColumn("_n_lines", F.size("_l").cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    repeats = F.col("_g").isNotNull() & (F.size(F.array_distinct("_g")) < F.size("_g"))
    d = d.withColumn("n_repeat_words", F.when(repeats, covered(F.col("_g"))).otherwise(0).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("_w", "_g", "_l")


def transformed(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    z = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log(1 + 100 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)).cast("double")),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return d.withColumns(dict(zip(Z, z)))


def _cholesky(p: DataFrame) -> DataFrame:
    """p with the factor l{i}{j} of the covariance s{i}{j} plus the floors, and its determinant."""
    for i, j in PAIRS:
        v = F.col(f"s{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        p = p.withColumn(f"l{i}{j}", F.sqrt(v) if i == j else v / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in range(P):
        det = det * F.col(f"l{i}{i}")
    return p.select(*GROUP, "n", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in PAIRS), (det * det).alias("det"))


def _distance(d: DataFrame) -> DataFrame:
    """d, whose rows have the estimate of their group, with the squared distance d2."""
    for i in range(P):
        y = F.col(Z[i]) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"_y{k}")
        d = d.withColumn(f"_y{i}", y / F.col(f"l{i}{i}"))
    return d.withColumn("d2", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, P)), F.col("_y0") * F.col("_y0")))


def _sums() -> list[Column]:
    return [F.count("*").alias("c"), *(F.sum(z).alias(f"t{i}") for i, z in enumerate(Z)), *(F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"t{i}{j}") for i, j in PAIRS)]


def _moments(s: DataFrame, factor: float) -> DataFrame:
    """Centre and covariance from summed rows c, t{i}, t{i}{j}."""
    mean = {i: F.col(f"t{i}") / F.col("c") for i in range(P)}
    cov = [((F.col(f"t{i}{j}") / F.col("c") - mean[i] * mean[j]) * factor) for i, j in PAIRS]
    cov = [F.greatest(c, F.lit(0.0)) if i == j else c for (i, j), c in zip(PAIRS, cov)]
    return s.select(*GROUP, "n", *(mean[i].alias(f"m{i}") for i in range(P)), *(c.alias(f"s{i}{j}") for (i, j), c in zip(PAIRS, cov)))


def _step(d: DataFrame, p: DataFrame) -> DataFrame:
    """One concentration step."""
    near = _distance(checked_join(d, p.drop("n"), GROUP, "inner"))
    near = near.withColumn("_bin", F.floor(F.log2(F.col("d2") + 1e-6) * OCTAVE).cast("int"))
    bins = near.groupBy(*GROUP, "n", "_bin").agg(*_sums())
    before = F.coalesce(F.sum("c").over(W.Window.partitionBy(*GROUP).orderBy("_bin").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    inside = bins.withColumn("_before", before).where(F.col("_before") < SHARE * F.col("n"))
    names = ["c", *(f"t{i}" for i in range(P)), *(f"t{i}{j}" for i, j in PAIRS)]
    return _cholesky(_moments(inside.groupBy(*GROUP, "n").agg(*(F.sum(x).alias(x) for x in names)), CONSISTENCY))


def _quartiles(d: DataFrame) -> DataFrame:
    """A start from the median and the quartiles of each coordinate, on a grid."""
    long = d.select(*GROUP, "n", F.posexplode(F.array(*(F.floor(F.col(z) * GRID).cast("int") for z in Z))).alias("i", "b"))
    bins = long.groupBy(*GROUP, "n", "i", "b").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.Window.partitionBy(*GROUP, "i").orderBy("b"))
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("n"), F.col("b")))
    q = bins.withColumn("_upto", upto).groupBy(*GROUP, "n", "i").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    pick = lambda i, c: F.max(F.when(F.col("i") == i, c))
    spread = (F.col("q3") - F.col("q1")) / F.lit(GRID * 1.349)
    p = q.groupBy(*GROUP, "n").agg(*(pick(i, (F.col("q2") + 0.5) / GRID).alias(f"m{i}") for i in range(P)), *(pick(i, spread * spread).alias(f"s{i}{i}") for i in range(P)))
    return _cholesky(p.withColumns({f"s{i}{j}": F.lit(0.0) for i, j in PAIRS if i != j}))


def estimates(d: DataFrame) -> DataFrame:
    """The estimate of each group (_lang, _source) of rows with z0..z3 and the group's size n."""
    best = None
    for start in (_cholesky(_moments(d.groupBy(*GROUP, "n").agg(*_sums()), 1.0)), _quartiles(d)):
        p = checkpoint(start)
        for _ in range(STEPS):
            p = checkpoint(_step(d, p))
        best = p if best is None else best.union(p)
    first = W.Window.partitionBy(*GROUP).orderBy("det", "m0", "m1", "m2", "m3")
    return best.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def verdicts(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text, lang, source): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance (null where the base rules reject).

    Rows that fail the base rules are rejected and take no part in the estimates. A language and source with under MIN_ROWS other
    rows joins the pool of its language's small ones; rows of a pool still under it are judged by an estimate over all rows, however
    few. Null languages and sources are groups
    like others. Ties, repeated rows and extra columns change nothing; an empty table gives no rows.
    """
    slim = transformed(counts(typed(docs, "doc_id long, text string, lang string, source string"))).drop("text")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    slim = checkpoint(slim.withColumn("_lang", key("lang")).withColumn("_own", key("source")).drop("lang", "source"))
    use = slim.where(~F.col("base_failed"))
    own = use.groupBy("_lang", "_own").count().where(F.col("count") >= MIN_ROWS).select("_lang", "_own", F.lit(True).alias("_big"))
    rows = checked_join(slim, own, ["_lang", "_own"]).withColumn("_source", F.when(F.col("_big"), F.col("_own")).otherwise("*")).drop("_own", "_big")
    sizes = rows.where(~F.col("base_failed")).groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS)
    rows = checked_join(rows, sizes.drop("n").withColumn("_enough", F.lit(True)), GROUP)
    rows = rows.withColumns({c: F.when(F.col("_enough"), F.col(c)).otherwise("*") for c in GROUP}).drop("_enough")
    judged = rows.where(~F.col("base_failed")).select(*GROUP, *Z)
    fit = checked_join(judged, sizes, GROUP, "inner")
    if judged.where("_lang = '*'").limit(1).count():
        fit = fit.unionByName(judged.withColumns({c: F.lit("*") for c in GROUP}).withColumn("n", F.lit(judged.count())))
    fit = checkpoint(fit)
    out = _distance(checked_join(rows, checkpoint(estimates(fit)), GROUP))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.round("d2", 6)).alias("distance"))


def op1_mcd_outliers(spark, sf_dir: str) -> DataFrame:
    """The statistics and the verdict of every document."""
    return verdicts(table(spark, sf_dir, "documents")).drop("distance")


def _sql() -> str:
    """The same in DuckDB SQL."""
    ws = "[\\x20\\x09-\\x0D]+"
    g = "lg, sg"
    sums = ", ".join(["count(*) c", *(f"sum({z}) t{i}" for i, z in enumerate(Z)), *(f"sum({Z[i]} * {Z[j]}) t{i}{j}" for i, j in PAIRS)])
    ctes = [
        "d as (select row_number() over () rid, doc_id, coalesce(text, '') text, coalesce('=' || lang, '-') lg, coalesce('=' || source, '-') own from documents)",
        f"w as (select rid, list_filter(string_split_regex(text, '{ws}'), lambda x: x <> '') w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from d)",
        "g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] t from (select rid, w, unnest(range(1, len(w) - 1)) i from w))",
        "r as (select rid, i from (select rid, i, count(*) over (partition by rid, t) c from g) where c > 1)",
        "cov as (select rid, count(distinct j) n from (select rid, unnest([i, i + 1, i + 2]) j from r) group by rid)",
        "s as (select d.rid, doc_id, lg, own, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, len(l)::bigint n_lines, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words from d join w using (rid) left join cov using (rid))",
        "b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed, ln(greatest(word_chars, 1) / greatest(n_words, 1)::double) z0, ln(1 + 100 * n_symbols / greatest(n_words, 1)::double) z1, sqrt(n_dup_lines / greatest(n_lines, 1)::double) z2, sqrt(n_repeat_words / greatest(n_words, 1)::double) z3 from s)",
        f"big as (select lg, own from b where not base_failed group by all having count(*) >= {MIN_ROWS})",
        "a as (select b.*, case when big.own is null then '*' else b.own end sg from b left join big on b.lg = big.lg and b.own = big.own)",
        f"sz as (select {g}, count(*) n from a where not base_failed group by all having count(*) >= {MIN_ROWS})",
        f"f as (select a.{', a.'.join(['lg', 'sg', *Z])}, n from a join sz using ({g}) where not base_failed)",
    ]

    def factor(name: str, source: str) -> None:
        """The Cholesky factor of source's covariance, column by column."""
        last = source
        for k, (i, j) in enumerate(PAIRS):
            v = f"s{i}{j}" + (f" + {FLOORS[i] ** 2!r}" if i == j else "") + "".join(f" - l{i}{q} * l{j}{q}" for q in range(j))
            ctes.append(f"{name}_{k} as (select *, {f'sqrt({v})' if i == j else f'({v}) / l{j}{j}'} l{i}{j} from {last})")
            last = f"{name}_{k}"
        ctes.append(f"{name} as (select *, power({' * '.join(f'l{i}{i}' for i in range(P))}, 2) det from {last})")

    def moments(source: str, factor_: float) -> str:
        cov = [f"(t{i}{j} / c - (t{i} / c) * (t{j} / c)) * {factor_!r}" for i, j in PAIRS]
        return f"select {g}, n, {', '.join(f't{i} / c m{i}' for i in range(P))}, {', '.join(f'greatest({c}, 0.0) s{i}{j}' if i == j else f'{c} s{i}{j}' for (i, j), c in zip(PAIRS, cov))} from {source}"

    def distance(name: str, rows: str, p: str, join: str) -> None:
        last = f"{rows} {join} join (select {g}, {', '.join(f'm{i}' for i in range(P))}, {', '.join(f'l{i}{j}' for i, j in PAIRS)} from {p}) using ({g})"
        for i in range(P):
            ctes.append(f"{name}_y{i} as (select *, (z{i} - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} y{i} from {last})")
            last = f"{name}_y{i}"
        ctes.append(f"{name} as (select *, {' + '.join(f'y{i} * y{i}' for i in range(P))} d2 from {last})")

    def step(name: str, p: str) -> None:
        distance(f"{name}_d", "f", p, "inner")
        ctes.append(f"{name}_b as (select {g}, n, floor(log2(d2 + 1e-6) * {OCTAVE})::int bin, {sums} from {name}_d group by all)")
        names = ["c", *(f"t{i}" for i in range(P)), *(f"t{i}{j}" for i, j in PAIRS)]
        ctes.append(f"{name}_i as (select {g}, n, {', '.join(f'sum({x}) {x}' for x in names)} from (select *, coalesce(sum(c) over (partition by {g} order by bin rows between unbounded preceding and 1 preceding), 0) bef from {name}_b) where bef < {SHARE} * n group by all)")
        ctes.append(f"{name}_m as ({moments(f'{name}_i', CONSISTENCY)})")
        factor(name, f"{name}_m")

    ctes.append(f"a0_t as (select {g}, n, {sums} from f group by all)")
    ctes.append(f"a0_m as ({moments('a0_t', 1.0)})")
    factor("a0", "a0_m")
    ctes.append("q_l as (" + " union all ".join(f"select {g}, n, {i} i, floor(z{i} * {GRID})::int b from f" for i in range(P)) + ")")
    ctes.append(f"q_u as (select *, sum(c) over (partition by {g}, i order by b) u from (select {g}, n, i, b, count(*) c from q_l group by all))")
    ctes.append(f"q_q as (select {g}, n, i, min(b) filter (u >= 0.25 * n) q1, min(b) filter (u >= 0.5 * n) q2, min(b) filter (u >= 0.75 * n) q3 from q_u group by all)")
    ctes.append(f"q_m as (select {g}, n, {', '.join(f'max((q2 + 0.5) / {GRID}) filter (i = {i}) m{i}' for i in range(P))}, {', '.join(f'max(power((q3 - q1) / {GRID * 1.349!r}, 2)) filter (i = {i}) s{i}{i}' if i == j else f'0.0::double s{i}{j}' for i, j in PAIRS)} from q_q group by {g}, n)")
    factor("q0", "q_m")
    for k in range(STEPS):
        step(f"a{k + 1}", f"a{k}")
        step(f"q{k + 1}", f"q{k}")
    cols = f"{g}, n, det, {', '.join(f'm{i}' for i in range(P))}, {', '.join(f'l{i}{j}' for i, j in PAIRS)}"
    ctes.append(f"best as (select * from (select {cols} from a{STEPS} union all select {cols} from q{STEPS}) qualify row_number() over (partition by {g} order by det, m0, m1, m2, m3) = 1)")
    distance("x", "a", "best", "left")
    with_ = ", ".join(c.replace(" as (", " as materialized (", 1) for c in ctes)
    return f"with {with_} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and coalesce(d2, 0.0) <= {CUTOFF}) kept from x"


ORACLE = _sql()
