"""Sequential mode: payments consume invoices in order, debtor by debtor."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "seq long, did long, ord long, rule string"


def _deplete(key, pay: pd.DataFrame, inv: pd.DataFrame) -> pd.DataFrame:
    """Exact amount first, then within 100 cents; the first open invoice in order."""
    open_ = {}
    for r in inv.sort_values("ord").itertuples():
        open_[r.ord] = r.a
    out = []
    for p in pay.sort_values("seq").itertuples():
        hit = next((o for o, a in open_.items() if a == p.x), None)
        rule = "EXACT"
        if hit is None:
            hit, rule = next((o for o, a in open_.items() if abs(a - p.x) <= 100), None), "ROUNDING"
        if hit is not None:
            del open_[hit]
            out.append((p.seq, p.did, hit, rule))
    return pd.DataFrame(out, columns=["seq", "did", "ord", "rule"])


def deplete(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row per payment that took an invoice. A task holds one debtor's open invoices, which is what order demands."""
    a = payments.select("seq", "did", "x").groupBy("did")
    b = invoices.select("did", "ord", "a").groupBy("did")
    return a.cogroup(b).applyInPandas(_deplete, SCHEMA)


def two_phase(results: DataFrame, share: float = 1 / 3) -> tuple[DataFrame, DataFrame]:
    """The part of the results that profiles are learnt from (the first payments in order) and the rest."""
    cut = results.agg(F.percentile_approx("seq", share, 10000)).first()[0]  # one number
    return results.where(F.col("seq") <= F.lit(cut)), results.where(F.col("seq") > F.lit(cut))
