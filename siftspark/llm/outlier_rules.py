"""Quality rules: base statistics, and robust multivariate outliers of them per language and source.

For each group a minimum-covariance-determinant estimate: from one start, medians and quartile ranges, concentration
steps keep the H share of rows nearest to the centre and re-estimate mean and covariance from them, so that the
determinant only falls, until it stands still; a reweighting step takes mean and covariance of the rows up to INNER.
Rows beyond CUTOFF in squared Mahalanobis distance go. All of it are aggregates by group; the distance uses a Cholesky
factor written out as column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm.common import SPACE, gathered, let, small, staged

#: Share of a group's rows that a concentration step keeps, most steps, and rows under which a group is judged by its language, a language by all rows.
H, STEPS, LEAST = 0.75, 30, 50
#: Consistency factor of the covariance of the nearest H for five normal variables.
FACTOR = 1.412
#: The reweighting step takes the rows up to this squared distance, the 0.975 quantile for five normal variables, and its consistency factor.
INNER, INNER_FACTOR = 12.83, 1.055
#: Squared distance beyond which a row goes. Statistics of clean prose have longer tails than the normal distribution,
#: so this is its 0.99999 quantile for five variables.
CUTOFF = 30.86
#: Spread below which a statistic's differences don't count: added, squared, to the variances. Each is small enough
#: that its statistic alone can pass CUTOFF; repeated words reach only the square root of 0.2, as the base rule ends there.
FLOOR = (0.06, 0.05, 0.10, 0.07, 0.06)
#: Bins of a factor e of the squared distance; they hold the quantile of a group in bounded space.
BINS = 100
P = len(FLOOR)
X = [f"x{i}" for i in range(P)]


def repeated_words(words: Column) -> Column:
    """Words in 5-word windows that are found twice or more in the text."""
    hashes = F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))).otherwise(F.expr("cast(array() as array<bigint>)"))

    def covered(h: Column) -> Column:
        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: merged(F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))))

    def merged(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct((i + 5).alias("end"), (a["n"] + i + 5 - F.greatest(i, a["end"])).alias("n")), lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    language = F.coalesce(F.col(lang_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), language.alias("language"), F.concat(F.lit("source\x1f"), language, F.lit("\x1f"), F.coalesce(source_col, F.lit(""))).alias("grp"), text.alias("body"),
        F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return rows.select(
        "doc_id", "language", "grp",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("body") - F.length(F.regexp_replace("body", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics: log mean word length, and square roots of shares of symbols, repeated lines, repeated words and capitals."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = [F.log(F.greatest(F.col("word_chars") / F.greatest("n_words", F.lit(1)), F.lit(1.0))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars")]
    return stats.withColumns({x: v.cast("double") for x, v in zip(X, values)})


def factored(moments: DataFrame, factor: float) -> DataFrame:
    """grp, means m_i and the Cholesky factor l_ij, from n, sums s_i and sums of products s_ij; covariances times `factor`."""
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    cov = {(i, j): (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor for i in range(P) for j in range(i + 1)}
    for i in range(P):
        for j in range(i + 1):
            less = sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            value = F.sqrt(F.greatest(cov[i, i] + FLOOR[i] ** 2 - less, F.lit(1e-9))) if i == j else (cov[i, j] - less) / F.col(f"l{j}_{j}")
            out = out.withColumn(f"l{i}_{j}", value)
    return out.select("grp", *[f"m{i}" for i in range(P)], *[f"l{i}_{j}" for i in range(P) for j in range(i + 1)])


def distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d2 by forward substitution."""
    for i in range(P):
        less = sum((F.col(f"l{i}_{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y{i}", (F.col(X[i]) - F.col(f"m{i}") - less) / F.col(f"l{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)), F.lit(0.0)))


def moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1)]
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *sums)


def estimates(rows: DataFrame, groups: int) -> DataFrame:
    """Centre and factor by grp: concentration steps until no group's determinant moves, then the reweighting step."""
    quarters = rows.groupBy("grp").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in X])
    zero = [F.lit(0.0).alias(f"l{i}_{j}") for i in range(P) for j in range(i)]
    found = quarters.select("grp", *[F.col(x)[1].alias(f"m{i}") for i, x in enumerate(X)], *zero, *[F.sqrt(F.pow((F.col(x)[2] - F.col(x)[0]) / 1.349, 2) + FLOOR[i] ** 2).alias(f"l{i}_{i}") for i, x in enumerate(X)])
    found = staged(found, "mcd-start", 1)
    determinant = sum((F.log(f"l{i}_{i}") for i in range(P)), F.lit(0.0))
    for step in range(STEPS):
        near = distance(rows.join(small(found, groups, 300), "grp")).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * BINS))
        counts = near.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("c"))
        order = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        cut = counts.withColumns({"upto": F.sum("c").over(order), "all": F.sum("c").over(Window.partitionBy("grp"))}).filter(F.col("upto") >= F.col("all") * H).groupBy("grp").agg(F.min("bin").alias("cut"))
        last, found = found, staged(factored(moments(near.join(small(cut, groups, 100), "grp").filter("bin <= cut")), FACTOR), f"mcd-{step}", 1)
        both = found.select("grp", determinant.alias("now")).join(last.select("grp", determinant.alias("before")), "grp")
        if not (both.agg(F.max(F.abs(F.col("now") - F.col("before")))).first()[0] or 0) > 1e-9:
            break
    near = distance(rows.join(small(found, groups, 300), "grp")).filter(F.col("d2") <= INNER)
    better = factored(moments(near), INNER_FACTOR)
    # A group whose rows are all beyond INNER keeps the estimate that was found.
    return staged(better.unionByName(found.join(better.select("grp"), "grp", "left_anti")), "mcd", 1)


def outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Groups of under LEAST rows that pass the base rules are judged by the estimate over all rows of their language, and
    languages of under LEAST such rows by that over all rows. Null language or source count as ''. A null text counts as empty (and fails the base rules, as n_words < 10). Repeated rows are
    judged each. Rows that fail the base rules don't take part in the estimates. Other columns are ignored.
    """
    stats = statistics(gathered(docs), id_col, text_col, lang_col, source_col)
    rows = staged(vectors(stats).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))), "stats")
    sizes = staged(rows.groupBy("grp", "language").agg(F.count_if(~F.col("base_failed")).alias("n")), "sizes")
    groups = sizes.count()
    languages = sizes.groupBy("language").agg(F.sum("n").alias("language_n"), F.min("n").alias("least"))
    rare = not languages.filter(F.col("language_n") < LEAST).isEmpty()
    known = sizes.join(small(languages, groups, 100), "language")
    pool = F.concat(F.lit("language\x1f"), "language")  # no group's name
    judge = F.when(F.col("n") >= LEAST, F.col("grp")).when(F.col("language_n") >= LEAST, pool).otherwise("all")
    # A row is judged by one estimate, and takes part in that of its group, and of its language and all rows where those judge others.
    part = F.array_compact(F.array(F.when(F.col("n") >= LEAST, F.col("grp")), F.when((F.col("least") < LEAST) & (F.col("language_n") >= LEAST), pool), F.when(F.lit(rare), F.lit("all"))))
    pooled = staged(known.select(F.col("grp").alias("of"), judge.alias("pool"), part.alias("part")), "pools")
    keyed = rows.join(small(pooled, groups, 300), rows["grp"] == pooled["of"]).drop("of", "grp")
    found = estimates(keyed.filter(~F.col("base_failed")).select(F.explode("part").alias("grp"), *X), 2 * groups + 1)
    keyed = keyed.drop("part").withColumnRenamed("pool", "grp")
    judged = distance(keyed.join(small(found, 2 * groups + 1, 300), "grp", "left"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"), F.col("d2").alias("distance"),
    )
