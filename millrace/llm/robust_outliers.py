"""Quality rules and robust multivariate outliers, all in DataFrame functions.

Each document gives a vector of four fixed-point statistics (mean word length, symbols per word, share
of repeated lines, share of words in repeated three-word windows). Per language and source, and per
language, the minimum covariance determinant estimate is sought from several starts: the three quarters of
the group that lie nearest to its medians by all coordinates, by each one, and by the worst. Concentration
steps (keep the three quarters nearest by Mahalanobis distance, take their mean and covariance, and again)
run until no determinant falls any more, at most STEPS times, and the start with the least one wins.
A source's estimate is joined by PRIOR documents' worth of its language's, which holds few documents of a
source to what is usual and fades as they grow in number. Distances are solved through a Cholesky factor
written out as column expressions. A variance floor keeps near-constant statistics from rejecting ordinary
documents.

Statistics are integers, so sums and sums of products are exact and results do not depend on the order
of rows. The nearest three quarters are found from a histogram of distances with fixed bins (ties of a
bin stay together): groups are only ever aggregated with partial sums, never held in one task.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.storage import discard, through_table

SCALE = 1000
DIMS = ("v1", "v2", "v3", "v4")
#: Variance floors in fixed point: five hundredths, and a tenth for repeated words.
FLOORS = (50.0**2, 50.0**2, 50.0**2, 100.0**2)
PRIOR = 40
STEPS = 20
SHARE = 0.75
#: Most groups whose cuts (a row for each start) are broadcast.
GROUPS = 100_000
#: A determinant that falls by less than this share has come to rest.
REST = 1e-3
#: The 0.9999 quantile of chi-square with four degrees of freedom.
CUTOFF = 23.513
#: Makes a three-quarters covariance consistent at the normal distribution with four dimensions.
CONSISTENCY = 1.606
#: Histogram bins per doubling of the distance.
BINS = 128
_PAIRS = list(combinations_with_replacement(range(len(DIMS)), 2))
_GROUP = ("glang", "gsource")
_SPACE = r"[\\x20\\x09-\\x0D]+"


def text_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    split = docs.select(
        "doc_id", "lang", "source", "text_hash",
        F.expr(f"array_remove(split(text, '{_SPACE}'), '')").alias("words"),
        F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr(r"char_length(translate(text, ' \t\n\u000b\u000c\r', ''))").cast("long").alias("word_chars"),
        F.expr("char_length(text) - char_length(translate(text, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
    )
    # Hashes of the three-word windows, then (hash, place) in order: neighbours with one hash are repeated.
    windows = split.select(
        "doc_id", "lang", "source", "text_hash", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        F.expr("size(lines) - size(array_distinct(lines))").cast("long").alias("n_dup_lines"),
        F.expr("if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))").alias("h"),
    )
    ordered = windows.withColumn("s", F.expr("if(size(array_distinct(h)) = size(h), null, sort_array(transform(h, (x, i) -> struct(x as x, i as i))))")).drop("h")
    repeated = ordered.withColumn(
        "p", F.expr("sort_array(transform(filter(s, (e, k) -> (k > 0 and s[k - 1].x = e.x) or (k + 1 < size(s) and s[k + 1].x = e.x)), e -> e.i))")
    ).drop("s")
    covered = "aggregate(transform(p, (x, k) -> if(k + 1 < size(p), least(3, p[k + 1] - x), 3)), 0, (a, x) -> a + x)"
    return repeated.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("p")


def _vector(stats: DataFrame) -> DataFrame:
    fixed = lambda e: F.expr(f"cast(floor({SCALE} * ({e}) + 0.5D) as bigint)")
    return stats.withColumns(
        {
            "v1": fixed("ln(1 + cast(word_chars as double) / greatest(n_words, 1))"),
            "v2": fixed("ln(1 + cast(n_symbols as double) / greatest(n_words, 1))"),
            "v3": fixed("cast(n_dup_lines as double) / greatest(n_lines, 1)"),
            "v4": fixed("cast(n_repeat_words as double) / greatest(n_words, 1)"),
        }
    )


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Number of rows, sums and sums of products of each group, from exact integers."""
    sums = [F.sum(F.col(d).cast("decimal(38,0)")).cast("double").alias(f"s{i}") for i, d in enumerate(DIMS)]
    sums += [F.sum((F.col(DIMS[i]) * F.col(DIMS[j])).cast("decimal(38,0)")).cast("double").alias(f"s{i}{j}") for i, j in _PAIRS]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("m"), *sums)


def _estimate(sums: DataFrame) -> DataFrame:
    """The sums with the mean, the Cholesky factor of the floored covariance, and its determinant."""
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("m") for i in range(len(DIMS))})
    cov = {}
    for i, j in _PAIRS:
        c = F.col(f"s{i}{j}") / F.col("m") - F.col(f"m{i}") * F.col(f"m{j}")
        cov[f"c{i}{j}"] = (F.greatest(c, F.lit(0.0)) if i == j else c) * CONSISTENCY + (FLOORS[i] if i == j else 0.0)
    out = _cholesky(out.withColumns(cov))
    return out.withColumn("det", F.expr(" * ".join(f"l{i}{i} * l{i}{i}" for i in range(len(DIMS)))))


def _cholesky(stats: DataFrame) -> DataFrame:
    """Replace the covariance c.. by its lower Cholesky factor l.. (column by column)."""
    for j in range(len(DIMS)):
        under = f"c{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        stats = stats.withColumn(f"l{j}{j}", F.expr(f"sqrt(greatest({under}, 1.0D))"))
        for i in range(j + 1, len(DIMS)):
            stats = stats.withColumn(f"l{i}{j}", F.expr(f"(c{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j}"))
    return stats.drop(*[f"c{i}{j}" for i, j in combinations_with_replacement(range(len(DIMS)), 2)])


def _distance(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """d2, the squared Mahalanobis distance, by forward substitution; null where the group has no estimate.

    A row comes back once for each estimate of its group.
    """
    out = rows.join(moments.drop("m", "det", *[c for c in moments.columns if c[0] == "s" and c != "start"]), list(_GROUP), "left")
    for i, d in enumerate(DIMS):
        out = out.withColumn(f"z{i}", F.expr(f"({d} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i}"))
    out = out.withColumn("d2", F.expr(" + ".join(f"z{i} * z{i}" for i in range(len(DIMS)))))
    return out.drop(*[c for c in moments.columns if c not in (*_GROUP, "start")], *[f"z{i}" for i in range(len(DIMS))])


def _nearest(rows: DataFrame, value: str, share: float, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, cut): the smallest value that at least `share` of the group do not exceed."""
    counts = rows.groupBy(*keys, F.col(value).alias("cut")).agg(F.count(F.lit(1)).alias("k"))
    by = Window.partitionBy(*keys)
    running = counts.withColumns({"below": F.sum("k").over(by.orderBy("cut")), "n": F.sum("k").over(by)})
    return running.where(F.col("below") >= F.ceil(F.col("n") * share)).groupBy(*keys).agg(F.min("cut").alias("cut"))


def _concentrated(rows: DataFrame, few: bool) -> DataFrame:
    """Estimates (glang, gsource, start) from the nearest of rows that have d2 for each start; few: whether there are at most GROUPS groups."""
    keys = (*_GROUP, "start")
    binned = rows.withColumn("bin", F.expr(f"cast(floor({BINS} * log2(d2 + 0.001D)) as bigint)"))
    cuts = _nearest(binned, "bin", SHARE, keys)
    near = binned.join(F.broadcast(cuts) if few else cuts, list(keys)).where("bin <= cut")
    return through_table(_estimate(_sums(near, *keys)), "moments")


def _start(rows: DataFrame) -> DataFrame:
    """Coordinate-wise median and median absolute deviation, as a diagonal estimate."""
    keys = ("glang", "gsource", "i")
    # Counts of distinct values stand for the rows from here on.
    values = rows.select("glang", "gsource", F.posexplode(F.array(*DIMS)).alias("i", "v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("k"))
    values = through_table(values, "values")

    def half(of: DataFrame) -> DataFrame:
        by = Window.partitionBy(*keys)
        running = of.withColumns({"below": F.sum("k").over(by.orderBy("x")), "n": F.sum("k").over(by)})
        return running.where("2 * below >= n").groupBy(*keys).agg(F.min("x").alias("x"))

    middle = half(values.withColumnRenamed("v", "x")).withColumnRenamed("x", "mid")
    apart = values.join(middle, list(keys)).withColumn("x", F.abs(F.col("v") - F.col("mid"))).groupBy(*keys, "x").agg(F.sum("k").alias("k"))
    both = half(apart).join(middle, list(keys))
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c))).cast("double")
    parts = both.groupBy("glang", "gsource").agg(*[pick("mid", i).alias(f"m{i}") for i in range(len(DIMS))], *[pick("x", i).alias(f"a{i}") for i in range(len(DIMS))])
    return parts.select(*_GROUP, *[f"m{i}" for i in range(len(DIMS))], *[(F.pow(F.col(f"a{i}") * 1.4826, 2) + FLOORS[i]).alias(f"c{i}") for i in range(len(DIMS))])


def least_determinant(vectors: DataFrame) -> DataFrame:
    """The sums and estimate of each (glang, gsource) whose covariance has the least determinant of all starts.

    `vectors` is read once a step and should be a table. The earliest start wins ties.
    """
    z = [F.pow(F.col(d) - F.col(f"m{i}"), 2) / F.col(f"c{i}") for i, d in enumerate(DIMS)]
    starts = F.array(z[0] + z[1] + z[2] + z[3], *z, F.greatest(*z))
    begun = vectors.join(through_table(_start(vectors), "start"), list(_GROUP)).select(*_GROUP, *DIMS, F.posexplode(starts).alias("start", "d2"))
    few = vectors.select(*_GROUP).distinct().limit(GROUPS + 1).count() <= GROUPS
    moments = _concentrated(begun, few)
    for _ in range(STEPS):
        before, moments = moments, _concentrated(_distance(vectors, moments), few)
        old = before.select(*_GROUP, "start", F.col("det").alias("old"))
        if moments.join(old, [*_GROUP, "start"]).where(F.col("det") < (1 - REST) * F.col("old")).isEmpty():
            break
        discard(before)
    best = F.min_by(F.struct(*[c for c in moments.columns if c not in (*_GROUP, "start")]), F.struct("det", "start"))
    return moments.groupBy(*_GROUP).agg(best.alias("b")).select(*_GROUP, "b.*")


def with_prior(estimates: DataFrame) -> DataFrame:
    """Each source's estimate with PRIOR documents' worth of its language's (gsource `*`) joined to it."""
    sums = [c for c in estimates.columns if c[0] == "s"]
    language = estimates.where("gsource = '*'").select("glang", F.col("m").alias("pm"), *[F.col(c).alias(f"p{c}") for c in sums])
    both = estimates.where("gsource <> '*'").select(*_GROUP, "m", *sums).join(language, "glang")
    both = both.select(*_GROUP, (F.col("m") + PRIOR).alias("m"), *[(F.col(c) + PRIOR * F.col(f"p{c}") / F.col("pm")).alias(c) for c in sums])
    return _estimate(both)


def quality_rules(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2, lang, source, text_hash.

    text_hash is xxhash64 of the text, that of a null text is fixed. base_failed: fewer than 50 words, or over half of the words in repeated three-word windows. kept is
    false for those and for documents whose distance exceeds the cutoff; estimates come from documents that
    pass the base rules. A null or empty text has no words and fails. Null languages and sources are groups
    of their own. Repeated rows are judged alike and each returned; other columns are ignored; an empty
    table gives an empty result. d2 is null for documents that fail the base rules.
    """
    stats = _vector(text_statistics(documents)).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    stats = through_table(stats, "statistics")
    # A prefix keeps nulls apart from any real value and from `*`, all sources of a language.
    named = stats.withColumns({"glang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "gsource": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    fit = named.where("not base_failed").select("glang", F.explode(F.array("gsource", F.lit("*"))).alias("gsource"), *DIMS)
    moments = through_table(with_prior(least_determinant(through_table(fit, "vectors"))), "estimates")
    judged = _distance(named, moments)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)).alias("kept"),
        F.when(~F.col("base_failed"), F.col("d2")).alias("d2"), "lang", "source", "text_hash",
    )
