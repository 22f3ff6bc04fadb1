"""Tolerance bands, credit notes and instalments: equi-joins on the debtor with one predicate chain per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BTP_RETENTION_PERCENT, INSTALLMENT_PERCENT, OUR_FEE_CENTS, ROUNDING_CENTS, SEPA_COUNTRIES, SWIFT_FEE_CENTS, WITHHOLDING_PERCENT


def _arms() -> list[tuple[str, Column, float, str, Column]]:
    """(rule, condition, confidence, flag, allocated cents) in the order in which they are tried. Bands are in 1/10000 of the invoice."""
    x, a = F.col("x"), F.col("a")
    d = x - a
    # |x - a (100 - p) / 100| < width * a / 1000, in whole numbers
    band = lambda p, width: F.abs(1000 * x - 10 * a * (100 - p)) < width * a
    expected = lambda p: F.expr("a * (100 - {0}) div 100".format(p))
    arms = [
        ("R-M004", (d != 0) & (F.abs(d) <= ROUNDING_CENTS), 0.99, "ROUNDING", x),
        ("R-M001", F.col("country").isNotNull() & ~F.col("country").isin(*SEPA_COUNTRIES) & (d >= -SWIFT_FEE_CENTS) & (d < 0), 0.95, "SWIFT_FEES", x),
        ("R-M002", F.contains(F.upper("label"), F.lit("OUR")) & (d >= -OUR_FEE_CENTS) & (d < 0), 0.96, "SEPA_OUR_FEES", x),
        ("R-M003", (F.col("discount_pct") > 0) & band(F.col("discount_pct"), 5), 0.97, "DISCOUNT_APPLIED", expected("discount_pct")),
        ("R-M005", (F.col("retention_pct") > 0) & band(F.col("retention_pct"), 5), 0.93, "RETENTION_APPLIED", expected("retention_pct")),
    ]
    for p in BTP_RETENTION_PERCENT:
        arms.append(("R-M005", (F.col("sector") == "BTP") & band(F.lit(p), 5), 0.91, "RETENTION_BTP", expected(p)))
    arms.append(("R-M009", (F.col("rfa_pct") > 0) & band(F.col("rfa_pct"), 5), 0.91, "RFA_DEDUCTED", expected("rfa_pct")))
    for country, p in WITHHOLDING_PERCENT.items():
        arms.append(("R-M010", (F.col("country") == country) & band(F.lit(p), 10), 0.90, "WITHHOLDING_TAX", expected(p)))
    for p in INSTALLMENT_PERCENT:
        arms.append(("R-M012", band(F.lit(100 - p), 10), 0.88, f"INSTALLMENT_{p}PCT", x))
    return arms


def classify() -> Column:
    """struct(rule, confidence, flag, allocated) of the first band that a payment-invoice pair falls into, else null."""
    out = None
    for rule, condition, confidence, flag, allocated in _arms():
        value = F.struct(F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"), F.lit(flag).alias("flag"), allocated.cast("long").alias("allocated"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def pairs(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Each payment with its debtor's invoices."""
    return payments.join(invoices, "did")


#: Width of a cell of relative amounts: one per cent of an invoice is 3.4 per cent of a payment of 30 per cent of it.
_CELL = 0.04


def unknown_pairs(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Payments without a debtor with the whole portfolio's invoices that a band open to them can fit.

    Those bands are a fixed number of cents or a share of the invoice, so payments look into cells of both kinds and
    their neighbours: an equi-join, whatever the portfolio's size. Columns of pairs(); did is null.
    """
    shares = [100, *INSTALLMENT_PERCENT]
    step = max(ROUNDING_CENTS, OUR_FEE_CENTS, SWIFT_FEE_CENTS) + 1
    log = lambda c: F.floor(F.log(c) / _CELL)
    cents = lambda c: F.struct(F.lit(0).alias("kind"), F.floor(c / step).alias("cell"))
    shared = lambda p, c: F.struct(F.lit(p).alias("kind"), c.alias("cell"))
    keys = F.array(cents(F.col("a")), *[F.when(F.col("a") > 0, shared(p, log(F.col("a") * p / 100))) for p in shares])
    open_ = invoices.drop("did").withColumn("_k", F.explode(F.array_compact(keys)))
    near = [cents(F.col("x") + d * step) for d in (-1, 0, 1)] + [F.when(F.col("x") > 0, shared(p, log(F.col("x")) + d)) for p in shares for d in (-1, 0, 1)]
    asked = payments.where("did is null").withColumn("_k", F.explode(F.array_compact(F.array(*near))))
    return asked.join(open_, "_k").drop("_k")


def first_per_payment(df: DataFrame, *order: str) -> DataFrame:
    """The first row of each payment. Ranks prune before the shuffle (group limits), so hot debtors send one row a task."""
    rank = F.row_number().over(Window.partitionBy("seq").orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def tolerance(payments: DataFrame, invoices: DataFrame, debtors: DataFrame) -> DataFrame:
    """seq, ord, rule, confidence, flag, allocated: the first invoice, in order, on which a band fires; of the whole portfolio where the debtor is unknown."""
    rich = payments.join(debtors.drop("iban", "name"), "did", "left")
    open_ = invoices.select("did", "ord", "a")
    every = pairs(rich, open_).unionByName(unknown_pairs(rich, open_))
    hits = every.withColumn("hit", classify()).where("hit is not null")
    return first_per_payment(hits.select("seq", "ord", "hit"), "ord").select("seq", "ord", "hit.*")


def credit_note(payments: DataFrame, invoices: DataFrame, credits: DataFrame) -> DataFrame:
    """One invoice less one credit note, exactly or within one per cent."""
    near = pairs(payments, invoices.select("did", "ord", "a")).join(credits, "did").where("a > c")
    off = F.abs(F.col("x") - (F.col("a") - F.col("c")))
    kind = F.when(off == 0, 0).when(100 * off < F.col("a"), 1)
    hits = near.withColumn("kind", kind).where("kind is not null").select("seq", "ord", "cid", "kind")
    best = first_per_payment(hits, "ord", "kind", "cid")
    return best.select("seq", "ord", "cid", F.when(F.col("kind") == 0, "R-M007").otherwise("R-M006").alias("rule"), F.when(F.col("kind") == 0, 0.97).otherwise(0.95).alias("confidence"))


def multi_credit(payments: DataFrame, invoices: DataFrame, credits: DataFrame, most: int = 10, largest: int = 4) -> DataFrame:
    """Two to four of the debtor's first invoices less one credit note, exactly; smaller sets first."""
    rank = F.row_number().over(Window.partitionBy("did").orderBy("ord"))
    top = invoices.withColumn("i", rank).where(f"i <= {most}").select("did", "i", "a")
    sets = top.select("did", F.array("i").alias("set"), F.col("a").alias("s"), F.col("i").alias("last"))
    found = None
    for n in range(2, largest + 1):
        sets = sets.join(top.withColumnsRenamed({"i": "i2", "a": "a2"}), "did").where("i2 > last").select("did", F.concat("set", F.array("i2")).alias("set"), (F.col("s") + F.col("a2")).alias("s"), F.col("i2").alias("last"))
        # equi-join on debtor and amount: what the set must leave
        hit = sets.join(credits, "did").select("did", "set", "cid", (F.col("s") - F.col("c")).alias("x")).join(payments.select("seq", "did", "x"), ["did", "x"]).select("seq", F.lit(n).alias("n"), "set", "cid")
        found = hit if found is None else found.unionByName(hit)
    return first_per_payment(found, "n", "set", "cid").select("seq", "n", F.concat_ws(",", F.transform("set", lambda i: i.cast("string"))).alias("positions"), "cid")


def installments(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Part payments whose label says so."""
    said = payments.where(F.upper("label").rlike("ACOMPTE|PARTIEL|PARTIAL|ADVANCE|A VALOIR|A COMPTE|AVANCE|PREPAYMENT"))
    pct = None
    for p in INSTALLMENT_PERCENT:
        hit = F.abs(100 * F.col("x") - p * F.col("a")) < F.col("a")
        pct = F.when(hit, p) if pct is None else pct.when(hit, p)
    hits = pairs(said, invoices.select("did", "ord", "a")).where("x < a").withColumn("pct", pct).where("pct is not null")
    return first_per_payment(hits.select("seq", "ord", "pct"), "ord").select("seq", "ord", "pct")
