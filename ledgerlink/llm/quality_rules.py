"""Quality rules: counts per document, then robust multivariate outliers.

Every document gets exact counts (words, symbols, repeated lines, words in repeated five-word windows). From them come
transformed statistics; for each language and source a minimum-covariance-determinant estimate of their location and
scatter is sought from several starts (medians and quartile ranges; moments of parts of the rows by hash). Each start
goes through concentration steps: keep the share `h` of rows nearest by Mahalanobis distance, estimate again. Of each
group's starts the one with the least determinant stays. A document further away than a chi-square limit is rejected.

Scatter of the nearest share is scaled to be consistent for normal rows. The statistics are not normal (most texts have
no odd sign at all, so tails are long): on 10,000 documents a limit at the quantile .99 rejects 3 % of those labelled
good and a limit at the normal deviate 8 rejects 0.03 % of them and 98 % of those labelled bad, hence LIMIT.

Every group is estimated on its own, whatever its size: each has `prior` further rows spread as the nearest share of all
documents (estimated alike), which count for little in a large group and carry a small one. A ridge keeps estimates of constant statistics
defined. Quantiles of distances are approximate (one part in 2,000 of a group).

Everything is DataFrame work: two grouped aggregates per step over a narrow table of statistics, which combine before
the shuffle, and estimates of a few numbers per group and start, joined by group and salt so that a hot source spreads
over tasks.

Defined cases: null text counts as empty (no words, so base_failed). Null language or source is a value of its own.
Repeated rows and ties are judged alike. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SALTS = 16
#: The group of all rows, which the others' further rows come from.
EVERY = "*"
#: Normal deviate of the limit on distances.
LIMIT = 8.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, the five counts, and the counts that only the statistics use (n_upper, n_lines, n_marks)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", *keep, text.alias("_t"))
    df = df.select(
        "doc_id", *keep,
        F.filter(F.split("_t", BLANK + "+"), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit(r"[!?|{}=_~^]")).cast("long").alias("n_marks"),
    )
    n = F.size("_w")
    window = lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(5)])
    df = df.select(
        "doc_id", *keep, "n_symbols", "n_upper", "n_marks",
        n.cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).alias("_h"),
    )
    # only texts that have a repeated window sort theirs
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda s, k: (s["h"] == F.get(F.col("_s"), k - 1)["h"]) | (s["h"] == F.get(F.col("_s"), k + 1)["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda s, k: F.coalesce(same(s, k), F.lit(False))), lambda s: s["i"])))
    gain = F.transform("_p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(5))))
    covered = F.coalesce(F.aggregate(gain, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return df.withColumn("n_repeat_words", covered).drop("_h", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistics() -> list[Column]:
    """Transformed statistics of a document; the added constants keep one odd sign in a short text harmless."""
    words = F.col("n_words").cast("double")
    rate = lambda c: F.log(F.col(c) / (words + 20) + 0.05)
    return [
        F.log((F.col("word_chars") + 20) / (words + 5)),
        rate("n_symbols"),
        rate("n_marks"),
        F.log(F.col("n_upper") / (F.col("word_chars") + 100) + 0.05),
        F.log(F.col("n_dup_lines") / (F.col("n_lines") + 10) + 0.1),
        F.log(F.col("n_repeat_words") / (words + 50) + 0.1),
    ]


def chi_square(p: int, z: float) -> float:
    """Wilson and Hilferty's approximation of the chi-square quantile at the normal deviate z."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def consistency(p: int, h: float) -> float:
    """What makes the scatter of the nearest share h of normal rows that of all of them."""
    if h >= 1:
        return 1.0
    q = chi_square(p, NormalDist().inv_cdf(h))
    z = ((q / (p + 2)) ** (1 / 3) - 1 + 2 / (9 * (p + 2))) / math.sqrt(2 / (9 * (p + 2)))
    return h / NormalDist().cdf(z)


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance by the inverse Cholesky factor w_i_j of the row's group."""
    out = F.lit(0.0)
    for i in range(p):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}_{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        out = out + F.pow(z, 2)
    return out


def _factor(groups: DataFrame, p: int, keys: tuple[str, ...]) -> DataFrame:
    """Inverse Cholesky factor columns w_i_j and log determinant from covariance columns c_i_j; later aliases build on earlier ones."""
    out = []
    for i in range(p):
        for j in range(i + 1):
            v = f"c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            out.append(f"sqrt(greatest({v}, 1e-6D)) AS l{i}_{i}" if i == j else f"({v}) / l{j}_{j} AS l{i}_{j}")
    for j in range(p):
        for i in range(j, p):
            v = ("1D" if i == j else "0D") + "".join(f" - l{i}_{k} * w{k}_{j}" for k in range(j, i))
            out.append(f"({v}) / l{i}_{i} AS w{i}_{j}")
    out.append(" + ".join(f"ln(l{i}_{i})" for i in range(p)) + " AS logdet")
    kept = [*keys, "logdet", *[f"m{i}" for i in range(p)], *[f"w{i}_{j}" for i in range(p) for j in range(i + 1)]]
    return groups.selectExpr(*keys, *[f"m{i}" for i in range(p)], *out).select(*kept)


def _estimates(df: DataFrame, p: int, ridge: float, prior: float, factor: float) -> DataFrame:
    """Location and scatter per group and start, of its rows in df and `prior` rows spread as those of EVERY."""
    names = [f"s{i}" for i in range(p)] + [f"s{i}_{j}" for i in range(p) for j in range(i + 1)]
    sums = [F.sum(f"x{i}") for i in range(p)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i + 1)]
    own = cut(df.groupBy("_g", "_start").agg(F.count(F.lit(1)).alias("n"), *[s.alias(c) for s, c in zip(sums, names)]), "sums")
    whole = own.where(F.col("_g") == EVERY).select("_start", F.col("n").alias("n_"), *[F.col(c).alias(f"{c}_") for c in names])  # a row a start
    g = own.join(F.broadcast(whole), "_start").select("_g", "_start", *[((F.col(c) + prior * F.col(f"{c}_") / F.col("n_")) / (F.col("n") + prior)).alias(c) for c in names])
    cov = [((F.col(f"s{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}")) * factor + F.lit(ridge if i == j else 0.0)).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)]
    return cut(_factor(g.select("_g", "_start", *[F.col(f"s{i}").alias(f"m{i}") for i in range(p)], *cov), p, ("_g", "_start")), "estimate")


def _salted(groups: DataFrame) -> DataFrame:
    """A group's few numbers for each part of its rows: a group with a large share of all rows is joined in SALTS places."""
    return groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def robust_outliers(rows: DataFrame, stats: list[Column], h: float = 0.75, steps: int = 3, starts: int = 3, z: float = LIMIT, ridge: float = 0.01, prior: float = 200.0, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """`rows` with distance2 (chi-square of len(stats) degrees for normal rows) and outlier.

    h: share of each group that estimates rest on; steps: concentration steps; starts: besides medians and quartiles, the
    moments of so many parts of the rows by hash; z: normal deviate of the chi-square limit; prior: rows spread as the
    nearest of all rows that each group has besides its own.
    """
    p = len(stats)
    xs = [f"x{i}" for i in range(p)]
    named = [F.concat(F.col(k).isNull().cast("string"), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys]
    place = {"_g": F.concat_ws("\u0001", *named), "_salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")}
    rows = cut(rows.withColumns({f"x{i}": s for i, s in enumerate(stats)} | place), "statistics")
    narrow = rows.select(F.explode(F.array("_g", F.lit(EVERY))).alias("_g"), "_salt", F.pmod(F.xxhash64("doc_id", F.lit(1), *xs), F.lit(max(starts, 1))).cast("int").alias("_part"), *xs)

    # starts: medians and quartile ranges, statistic by statistic; moments of parts
    quart = narrow.groupBy("_g").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, x in enumerate(xs)])
    spread = lambda i: F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.35, 2) + F.lit(ridge)
    first = quart.select("_g", F.lit(-1).alias("_start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(p)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)])
    estimate = cut(_factor(first, p, ("_g", "_start")), "estimate")
    if starts:
        estimate = estimate.unionByName(_estimates(narrow.withColumnRenamed("_part", "_start"), p, ridge, prior, 1.0))
    for step in range(steps):
        near = narrow.join(_salted(estimate), ["_g", "_salt"]).select("_g", "_start", "_salt", *xs, _distance(p).alias("_d"))
        limit = near.groupBy("_g", "_start").agg(F.percentile_approx("_d", h, 2000).alias("_limit"))
        inside = near.join(_salted(limit), ["_g", "_start", "_salt"]).where("_d <= _limit")
        estimate = _estimates(inside, p, ridge, prior, consistency(p, h))
    least = estimate.groupBy("_g").agg(F.min(F.struct("logdet", "_start")).alias("_b")).select("_g", F.col("_b._start").alias("_start"))
    near = rows.join(_salted(estimate.join(least, ["_g", "_start"])), ["_g", "_salt"])
    out = near.withColumn("distance2", _distance(p)).withColumn("outlier", F.col("distance2") > F.lit(chi_square(p, z)))
    return out.drop("_g", "_salt", "_start", "logdet", *xs, *[f"m{i}" for i in range(p)], *[f"w{i}_{j}" for i in range(p) for j in range(i + 1)])


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, distance2, kept."""
    counted = base_counts(docs.select("doc_id", "text", "lang", "source"), ("lang", "source"))
    judged = robust_outliers(counted, statistics(), **options)
    failed = base_failed()
    return judged.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & ~F.col("outlier")).alias("kept"), "distance2")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, all columns, that the rules keep."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text", "lang", "source")}
    ids = {"_r1": F.xxhash64(at["doc_id"], at["text"], at["lang"], at["source"]), "_r2": F.xxhash64(at["text"], at["source"], at["lang"], at["doc_id"])}
    counted = base_counts(plain.select(*[c.alias(k) for k, c in at.items()], *[c.alias(k) for k, c in ids.items()]), ("lang", "source", *ids))
    judged = robust_outliers(counted, statistics(), **options)
    good = judged.where(~base_failed() & ~F.col("outlier")).select(*ids)
    return plain.withColumns(ids).join(good, list(ids), "left_semi").select(*[F.col(c).alias(a) for c, a in zip(names, docs.columns)])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
