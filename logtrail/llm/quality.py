"""Quality rules: counts of a text by built-in functions, and robust multivariate outliers of their shares.

For each language and source the minimum-covariance-determinant estimate is fitted by concentration steps: from each of
three starts keep the 75 % of rows that lie nearest, take their mean and covariance, repeat until no determinant falls,
take the smallest, then reweight. A document whose transformed statistics lie too far by Mahalanobis distance is rejected.
Everything is DataFrame work: statistics are rounded to integers, so sums are exact and repeat to the bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm.common import materialize, table

BLANK = r"[\x20\x09-\x0D]+"
#: Statistics in thousandths: log of the mean word length, and square roots of three shares.
STATS = ("x1", "x2", "x3", "x4")
#: Variance of the square root of a share in thousandths, times the number of independent trials behind the share; the
#: log of a mean word length has about the same, as the spread of word lengths is about half their mean.
TRIAL = 250_000.0
SHARE, MOST_STEPS, LEAST_ROWS = 0.75, 20, 100
#: Groups whose estimates are broadcast at most; a row of them is some 200 bytes.
GROUPS = 10_000
#: Quantiles of the chi-square distribution with 4 degrees: at 0.75, 0.975 and 0.999. The last rejects: one in a
#: thousand texts that vary as their group does is the loss accepted, set beforehand and not by labels.
NEAR, WITHIN, FAR = 5.385269, 11.143287, 18.466827


def text_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines. Null texts count as empty."""
    text = F.coalesce(docs[text_column], F.lit(""))
    df = docs.select(docs[id_column].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), text.alias("t"))
    df = df.withColumns({"words": F.array_remove(F.split("t", BLANK), ""), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.select(
        "doc_id", "lang", "source", "words", F.size("words").alias("n"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    hashes = F.when(F.col("n") > 8, F.transform(F.sequence(F.lit(1), F.col("n") - 7), lambda i: F.xxhash64(F.slice("words", i, 8))))
    df = df.withColumn("h", hashes).drop("words")
    df = df.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    # where any window repeats: sort (hash, place), take the places whose neighbour has the same hash
    df = df.withColumn("s", F.when(F.col("again"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h")
    same = lambda x, k: (F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"])
    places = F.array_sort(F.filter(F.transform("s", lambda x, k: F.when(F.coalesce(same(x, k), F.lit(False)), x["i"])), lambda i: i.isNotNull()))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(8), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return df.select("doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.when(F.col("again"), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def statistics(counts: DataFrame) -> DataFrame:
    """Adds base_failed and the transformed statistics; a neighbour in hash-null order does not matter: rows only."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    values = (F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words))
    return counts.withColumn("base_failed", base_failed()).withColumns({x: F.round(1000 * v).cast("long") for x, v in zip(STATS, values, strict=True)})


def grouped(spark: SparkSession, stats: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Adds the group g that judges a row, many (whether there is one), and fits: the groups whose estimates it enters.

    A row is judged by its language and source; where they have too few usable rows, by all usable rows of the
    language, else by all usable rows. Wider groups are fitted only where they judge.
    """
    none = F.lit(None).cast("string")
    key = lambda k, lang, source: F.to_json(F.struct(F.lit(k).alias("k"), lang.alias("lang"), source.alias("source")))
    stats = stats.withColumn("g", key("s", F.col("lang"), F.col("source")))
    sizes = materialize(spark, stats.groupBy("g").agg(F.first(key("l", F.col("lang"), none)).alias("l"), F.count_if(~F.col("base_failed")).alias("n")), "quality-sizes")
    langs = sizes.groupBy("l").agg(F.sum("n").alias("n_l"), F.bool_or(F.col("n") < least).alias("few_l"))
    total = langs.agg(F.sum("n_l").alias("n_r"), F.bool_or(F.col("few_l") & (F.col("n_l") < least)).alias("few_r"))
    own, of_lang, of_all = F.col("n") >= least, F.col("n_l") >= least, F.col("n_r") >= least
    rest = key("r", none, none)
    groups = sizes.join(langs, "l").crossJoin(F.broadcast(total)).select(
        "g", F.when(own, F.col("g")).when(of_lang, F.col("l")).when(of_all, rest).alias("by"),
        F.array_compact(F.array(F.when(own, F.col("g")), F.when(of_lang & F.col("few_l"), F.col("l")), F.when(of_all & F.col("few_r"), rest))).alias("fits"),
    )
    out = beside(spark, stats, materialize(spark, groups, "quality-keys"))
    return out.drop("g").withColumnRenamed("by", "g").withColumn("many", F.col("g").isNotNull())


def least_variances() -> list[Column]:
    """What each statistic of a row varies by however alike its group's texts are: by the words, lines or windows it has.

    Symbols come by the word and repeats by the window of 8 words, so these are the trials, not letters or words.
    Rounding adds a twelfth and matters only to texts of millions of words.
    """
    words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines"))
    return [F.greatest(TRIAL * k / n, F.lit(1 / 12)) for k, n in ((1, words), (1, words), (1, lines), (8, words))]


def fitted(rows: DataFrame, scale: float, near: Column | None = None) -> DataFrame:
    """Mean and covariance of each group's rows, or of those that are near; sums of integers in decimal are exact.

    near is a column that the sums look at, not a filter: a filter on a distance is moved below the columns that the
    distance comes from, each written out in the next, to more code than a method may hold.
    """
    p = range(len(STATS))
    rows = rows.withColumn("near", F.lit(True) if near is None else near)
    total = lambda x: F.sum(F.when(F.col("near"), x).cast("decimal(20,0)")).cast("double")
    sums = rows.groupBy("g").agg(
        F.count_if("near").cast("double").alias("n"), *(total(F.col(STATS[i])).alias(f"m{i}") for i in p),
        *(total(F.col(STATS[i]) * F.col(STATS[j])).alias(f"c{i}{j}") for i in p for j in p if j <= i),
    ).filter("n > 0")
    out = sums.withColumns({f"m{i}": F.col(f"m{i}") / F.col("n") for i in p})
    out = out.withColumns({f"c{i}{j}": scale * (F.col(f"c{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) for i in p for j in p if j <= i})
    return out.select("g", *(f"m{i}" for i in p), *(f"c{i}{j}" for i in p for j in p if j <= i))


def are_few(fit: DataFrame) -> bool:
    """Whether there are at most GROUPS estimates; those of the same groups need not be counted again."""
    return fit.limit(GROUPS + 1).count() <= GROUPS


def beside(spark: SparkSession, rows: DataFrame, fit: DataFrame, few: bool | None = None, how: str = "inner") -> DataFrame:
    """rows, each with the written estimate of its group, for grouping anew.

    Few estimates, counted unless `few` tells it, are broadcast. More of them are joined by shuffles, and the join is written: grouped at
    once, all rows of a hot group would meet in one task, while so Spark splits the join and sums before grouping.
    """
    if are_few(fit) if few is None else few:
        return rows.join(F.broadcast(fit), "g", how)
    return materialize(spark, rows.join(fit, "g", how), "mcd-rows")


def with_distance(spark: SparkSession, stats: DataFrame, fit: DataFrame, few: bool | None = None) -> DataFrame:
    """Adds the squared Mahalanobis distance d2, by Cholesky's factor and forward substitution; null without a fit.

    The variance that remains of a statistic, given those before it, is taken to be the row's least one where it is
    below that: a bound, nothing is added to a larger variance, and no factor is singular.
    """
    p = range(len(STATS))
    out = beside(spark, stats, fit, few, "left")
    for i, least in zip(p, least_variances(), strict=True):
        for k in range(i):
            rest = F.col(f"c{i}{k}")
            for j in range(k):
                rest = rest - F.col(f"l{i}{j}") * F.col(f"l{k}{j}")
            out = out.withColumn(f"l{i}{k}", rest / F.col(f"l{k}{k}"))
        rest, off = F.col(f"c{i}{i}"), F.col(STATS[i]) - F.col(f"m{i}")
        for k in range(i):
            rest, off = rest - F.col(f"l{i}{k}") * F.col(f"l{i}{k}"), off - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"l{i}{i}", F.sqrt(F.greatest(rest, least)))
        out = out.withColumn(f"z{i}", off / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in p[1:]), F.col("z0") * F.col("z0"))
    return out.select(*stats.columns, d2.alias("d2"))


def with_determinant(fit: DataFrame) -> DataFrame:
    """Adds det, the logarithm of the determinant of the covariance; what remains of a statistic is a rounding at least."""
    out, p = fit, range(len(STATS))
    for i in p:
        for k in range(i + 1):
            rest = F.col(f"c{i}{k}")
            for j in range(k):
                rest = rest - F.col(f"l{i}{j}") * F.col(f"l{k}{j}")
            least = F.sqrt(F.greatest(rest, F.lit(1 / 12)))
            out = out.withColumn(f"l{i}{k}", least if i == k else rest / F.col(f"l{k}{k}"))
    return out.select(*fit.columns, (2 * sum((F.log(f"l{i}{i}") for i in p[1:]), F.log("l00"))).alias("det"))


def starts(spark: SparkSession, some: DataFrame) -> DataFrame:
    """Three estimates for each group g, named g#1 to g#3: rough ones to begin at.

    Medians and median deviations; mean and covariance of all rows; mean and covariance of the rows within two median
    deviations (or rounding) of the median in every statistic.
    """
    p = range(len(STATS))
    middle = materialize(spark, some.groupBy("g").agg(*(F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(STATS))), "mcd-middle")
    few, off = are_few(middle), [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(STATS)]
    spread = beside(spark, some, middle, few).groupBy("g").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in p), *(F.percentile(x, F.lit(0.5)).alias(f"s{i}") for i, x in enumerate(off)))
    spread = materialize(spark, spread, "mcd-spread")
    square = [F.pow(1.4826 * F.col(f"s{i}"), F.lit(2.0)) for i in p]
    rough = spread.select("g", *(f"m{i}" for i in p), *((square[i] if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in p for j in p if j <= i))
    inside = beside(spark, some, spread, few)
    for i, x in enumerate(off):
        inside = inside.filter(x <= 2 * F.greatest(F.col(f"s{i}"), F.lit(1.0)))
    three = [rough, fitted(some, 1.0), fitted(inside.select("g", *STATS), 1.0)]
    named = [x.withColumn("g", F.concat("g", F.lit(f"#{k}"))) for k, x in enumerate(three, 1)]
    return materialize(spark, named[0].unionByName(named[1]).unionByName(named[2]), "mcd-fit")


def minimum_covariance(spark: SparkSession, stats: DataFrame) -> DataFrame:
    """The reweighted estimate for each group g of stats: of three starts' estimates that of the smallest determinant.

    From each start concentration steps go on until no determinant falls any more, MOST_STEPS at most. A step reads the
    small table of statistics, never the texts. Quantiles are taken over distances in fine steps, so a group of any
    size is a bounded count by step, summed before the shuffle.
    """
    some = stats.filter("NOT base_failed").select(F.explode("fits").alias("g"), *STATS, "n_words", "n_lines")
    fit = starts(spark, some)
    few = are_few(fit)
    every = some.withColumn("g", F.explode(F.array(*(F.concat("g", F.lit(f"#{k}")) for k in (1, 2, 3)))))
    # the covariance of the nearest 75 % of normal rows is smaller than that of all, by this factor
    scale = SHARE / (1 - math.exp(-NEAR / 2) * (1 + NEAR / 2 + (NEAR / 2) ** 2 / 2))
    step, begun = F.floor(100 * F.log1p("d2")), False
    for _ in range(MOST_STEPS):
        far = with_distance(spark, every, fit, few)
        cut = materialize(spark, far.groupBy("g").agg(F.percentile(step, F.lit(SHARE)).alias("cut")), "mcd-cut")
        new = with_determinant(fitted(beside(spark, far, cut, few), scale, step <= F.col("cut")))
        if not begun:
            fit, begun = materialize(spark, new, "mcd-fit"), True
            continue
        # where the determinant does not fall, the estimate before it stays
        names = [c for c in new.columns if c != "g"]
        both = beside(spark, new, fit.select("g", F.struct(*names).alias("old")), few)
        fell = F.col("det") < F.col("old")["det"] - 1e-6
        fit = both.select("g", fell.alias("fell"), *(F.when(fell, F.col(c)).otherwise(F.col("old")[c]).alias(c) for c in names))
        fit = materialize(spark, fit, "mcd-fit")
        if not fit.filter("fell").limit(1).count():
            break
    one = fit.withColumn("start", F.element_at(F.split("g", "#"), -1)).withColumn("g", F.regexp_replace("g", "#[123]$", ""))
    columns = [c for c in one.columns if c not in ("g", "det", "fell", "start")]
    least = one.groupBy("g").agg(F.min_by(F.struct(*columns), F.struct("det", "start")).alias("fit")).select("g", "fit.*")
    least = materialize(spark, least, "mcd-fit")
    return materialize(spark, fitted(with_distance(spark, some, least, few), 1.0, F.col("d2") <= WITHIN), "mcd-fit")


def judge(spark: SparkSession, docs: DataFrame, far: float = FAR) -> DataFrame:
    """The counts of each row of docs, base_failed, d2 and kept.

    Null languages and sources are groups of their own. Groups of fewer than LEAST_ROWS usable rows are judged
    by the estimate over all usable rows of the language, else over all; where even these are few there is no fit and
    only the base rules decide. Null and empty
    texts fail the base rule. Repeated rows count each time; ties at the 75 % are all kept. Of a long text one array of
    hashes, 8 bytes a word, is held beside its words. Other columns of docs are not looked at. An empty table gives no
    rows.
    """
    stats = materialize(spark, grouped(spark, materialize(spark, statistics(text_counts(docs)), "quality-stats")), "quality-groups")
    out = with_distance(spark, stats.drop("fits"), minimum_covariance(spark, stats))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= far, F.lit(True)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base rule and verdict; see judge."""
    return judge(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
