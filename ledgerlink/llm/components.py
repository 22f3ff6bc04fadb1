"""Connected components by alternating large and small stars over an edge table; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cuts


def _is_star_forest(e: DataFrame) -> bool:
    """Every u has one v, and no v is a u."""
    degree = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    inner = e.select("v").distinct().join(degree.select(F.col("u").alias("v"), F.lit(True).alias("low")), "v")
    return not degree.where("n > 1").select("u").unionByName(inner.select(F.col("v").alias("u"))).limit(1).count()


def connected(edges: DataFrame, most: int = 50) -> DataFrame:
    """id, component (smallest id reachable) of every id in edges (u, v), two long columns."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most):
        if _is_star_forest(e):
            roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e, before = cut(small.distinct(), "links"), e
        drop_cuts(before)
    raise RuntimeError("components did not settle")
