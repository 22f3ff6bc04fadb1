"""What a debtor's labels look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STOP_WORDS = ("DE", "DU", "LA", "LE", "LES", "DES", "ET", "THE", "OF", "AND", "FOR")


def masked(label: Column) -> Column:
    """References, document numbers and numbers as placeholders."""
    c = F.regexp_replace(F.upper(label), r"\b(FAC|INV)[A-Z]*[ /-]*[0-9O]+([ /-]+[0-9O]+)*", "<REF>")
    c = F.regexp_replace(c, r"\bPO[ /-]*[0-9]+", "<PO>")
    c = F.regexp_replace(c, r"\bBL[ /-]*[0-9]+", "<BL>")
    return F.regexp_replace(c, r"\b[0-9]+\b", "<NUM>")


def top_tokens(payments: DataFrame, k: int = 15) -> DataFrame:
    """did, token, n: each debtor's most frequent label tokens."""
    each = payments.select("did", F.explode(F.split(masked(F.col("label")), r"\s+")).alias("token")).where(~F.col("token").isin("", *STOP_WORDS))
    count = each.groupBy("did", "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("did").orderBy(F.desc("n"), "token")
    return count.withColumn("k", F.row_number().over(w)).where(f"k <= {k}").drop("k")


def label_profile(payments: DataFrame) -> DataFrame:
    """did, mean_length, empty_share, short_share: how much a debtor's labels say."""
    words = F.size(F.split(F.trim("label"), r"\s+"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return payments.groupBy("did").agg(F.round(F.avg(F.length("label")), 6).alias("mean_length"), share(F.length(F.trim("label")) < 3).alias("empty_share"), share(words <= 2).alias("short_share"))
