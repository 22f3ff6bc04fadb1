"""URL filters: listed rules first, then a verdict per host from the link graph.

A rule `host/path` fits its host and all subdomains where the url's path starts with its path; the longest rule wins.
Pages without a rule get their host's verdict. Hosts are judged by propagation over host edges (absolute links in the
pages' html, counted per pair of hosts before anything is shuffled): personalised PageRank spreads trust along links
from trusted seeds, and reversed PageRank spreads distrust to hosts that link to blocked seeds. A host is blocked if
its distrust is at least `threshold` of the mean seed's and above its trust.

Seeds: a host is a blocked seed if rules block at least half of its pages, and a trusted seed if rules allow some of
its pages and it is not a blocked seed. Mass that reaches a host without links ends there.

Defined cases: a null url, or one without ://, has an empty host and path and no links, fits no rule and is allowed.
A null html has no links. Repeated rows each get a verdict. Ties between rules of equal length go to the rule that is
first in text order, block before allow. Extra columns are ignored. An empty table gives an empty result. DataFrame
functions only; the iterations are cut into tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cuts

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: kind, rule
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    names = ("kind", "rule", "rule_host", "rule_path")
    rows = [(kind, rule, rule.partition("/")[0], "/" + rule.partition("/")[2]) for kind, rule in rules]
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(c) for c in names])
    each = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.explode(each).alias("r")).select("r.*")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: those that fit the host, longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    order = F.struct((-F.length("rule")).alias("n"), "rule", (F.col("kind") != "block").alias("k"), "rule_path", "kind")
    return each.groupBy("host").agg(F.sort_array(F.collect_set(order)).alias("rules"))  # as many as the rule list has for one host


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: absolute links between different hosts."""
    host, _ = split_url(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER))).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-4, damping: float = 0.85, cut_every: int = 4, iterations: int | None = None) -> DataFrame:
    """host, trust, distrust. edges: src, dst, n. seeds: host, kind ('t' or 'd'), weight; weights of a kind sum to 1.

    Goes on until an iteration moves no more than `tolerance` of the mass of a kind, looked at every `cut_every`
    iterations; what moves shrinks by `damping` at least each time, so that is soon. `iterations`: so many instead.
    """
    ways = edges.select(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    total = cut(ways.groupBy("kind", "a").agg(F.sum("n").alias("total")), "totals")
    ways = cut(ways.join(total, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("total")).alias("p")), "edges")
    base = seeds.select("kind", F.col("host").alias("b"), (F.col("weight") * (1 - damping)).alias("r"))
    rank, i, held = base, 0, []
    while iterations is None or i < iterations:
        i += 1
        moved = rank.withColumnRenamed("b", "a").join(ways, ["kind", "a"]).select("kind", "b", (F.col("r") * F.col("p") * damping).alias("r"))
        rank, before = moved.unionByName(base).groupBy("kind", "b").agg(F.sum("r").alias("r")), rank
        if i % cut_every == 0:
            before = cut(before, "rank")
            rank = cut(rank, "rank")
            drop_cuts(*held)
            held = [before, rank]
            change = rank.unionByName(before.withColumn("r", -F.col("r"))).groupBy("kind", "b").agg(F.abs(F.sum("r")).alias("r")).groupBy("kind").agg(F.sum("r").alias("r")).agg(F.max("r")).first()[0]  # one number
            if iterations is None and (change or 0.0) <= tolerance:
                break
    mass = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0))
    return rank.groupBy(F.col("b").alias("host")).agg(mass("t").alias("trust"), mass("d").alias("distrust"))


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = 0.05, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of the host."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    counts = urls.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    ruled = rules_by_host(counts, rules_table(spark, rules))
    fit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    # a table of its own: the join may split a hot host, and counts combine before their shuffle
    urls = cut(urls.join(ruled, "host", "left").withColumn("fit", fit).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.kind").alias("kind")), "ruled")
    per = urls.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("kind") == "allow").alias("good"), F.count_if(F.col("kind") == "block").alias("bad"))
    per = cut(per, "hosts")  # one row a host
    blocked = 2 * F.col("bad") >= F.col("pages")
    picked = per.where("good + bad > 0").select("host", F.when(blocked, "d").when(F.col("good") > 0, "t").alias("kind")).where("kind is not null")
    sizes = picked.groupBy("kind").agg(F.count(F.lit(1)).alias("seeds"))  # two rows
    seeds = cut(picked.join(F.broadcast(sizes), "kind").select("host", "kind", "seeds", (1 / F.col("seeds")).alias("weight")), "seeds")
    edges = cut(host_edges(pages), "links")
    ranks = propagate(edges, seeds, **options)
    n_bad = seeds.where("kind = 'd'").agg(F.max("seeds")).first()[0] or 1  # one number
    verdict = ranks.select("host", "trust", "distrust", ((F.col("distrust") * n_bad >= threshold) & (F.col("distrust") > F.col("trust"))).alias("banned"))
    out = urls.join(verdict, "host", "left")
    said = F.coalesce(F.col("kind"), F.when(F.col("banned"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
