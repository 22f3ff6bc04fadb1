"""Review queue: candidates, priorities, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AUTO_CONFIDENCE
from .tolerance import classify, pairs

#: Hours until an item of the queue is due.
DUE_HOURS = 24
_AMOUNT, _AGE, _DOUBT, _RISK = 0.30, 0.25, 0.25, 0.20


def candidates(payments: DataFrame, invoices: DataFrame, debtors: DataFrame) -> DataFrame:
    """seq, ord, rule, confidence of every pair that a tolerance band fits."""
    rich = payments.join(debtors.drop("iban", "name"), "did", "left")
    hits = pairs(rich, invoices.select("did", "ord", "a")).withColumn("hit", classify()).where("hit is not null")
    return hits.select("seq", "ord", "hit.rule", "hit.confidence")


def best_candidate(found: DataFrame) -> DataFrame:
    """The surest candidate of each payment, the first invoice of equally sure ones. One row a payment leaves each task."""
    best = found.groupBy("seq").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "ord", "rule")).alias("b"))
    return best.select("seq", F.col("b.ord").alias("ord"), F.col("b.rule").alias("rule"), (-F.col("b.c")).alias("confidence"))


def priority(x: Column, age_days: Column, confidence: Column, risk: Column) -> Column:
    """Amount, age, nearness to the automatic threshold, risk; unknown ages and risks count half, no candidate .3."""
    amount = F.least(x / 10000000.0, F.lit(1.0))
    age = F.coalesce(F.least(age_days / 30.0, F.lit(1.0)), F.lit(0.5))
    doubt = F.when(confidence.isNotNull(), 1 - F.least(F.abs(confidence - AUTO_CONFIDENCE) / 0.5, F.lit(1.0))).otherwise(0.3)
    return _AMOUNT * amount + _AGE * age + _DOUBT * doubt + _RISK * F.coalesce(risk, F.lit(0.5))


def queue(payments: DataFrame, invoices: DataFrame, debtors: DataFrame, as_of: str) -> DataFrame:
    """seq, did, priority, deadline of the payments whose best candidate is not sure enough to be matched."""
    best = best_candidate(candidates(payments, invoices, debtors)).select("seq", "confidence")
    rows = payments.select("seq", "did", "day", "x").join(best, "seq", "left").where(F.coalesce(F.col("confidence") < AUTO_CONFIDENCE, F.lit(True)))
    rows = rows.join(debtors.select("did", "risk_pct"), "did", "left")
    p = priority(F.col("x"), F.datediff(F.lit(as_of).cast("date"), F.col("day")), F.col("confidence"), F.col("risk_pct") / 100)
    return rows.select("seq", "did", F.round(p, 6).alias("priority"), F.date_add("day", DUE_HOURS // 24).alias("deadline"))


def queue_places(items: DataFrame) -> DataFrame:
    """Each item's place in its debtor's queue: by priority, then arrival."""
    w = Window.partitionBy("did").orderBy(F.desc("priority"), "seq")
    return items.withColumn("place", F.row_number().over(w))


def next_items(items: DataFrame, n: int = 1, assigned: DataFrame | None = None) -> DataFrame:
    """The first n items of the whole queue that nobody has; assigned: seq of those that somebody has. Each task sends n."""
    free = items if assigned is None else items.join(assigned.select("seq"), "seq", "left_anti")
    return free.orderBy(F.desc("priority"), "seq").limit(n)
