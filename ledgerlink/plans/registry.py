"""Queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals, similarity, text
from ..operators import combinatorial as cb
from ..operators import exact, fuzzy, profiler, review, scoring, temporal, tolerance
from ..sources.durable import cut
from ..sources.fixtures import oracle, run_sql, table, view
from . import cascade, sequential
from .oracles import ORACLES
from .reports import QUEUES, REPORTS, TOLERANCE

FLAGSHIP = "cascade"


def _views(*names: str):
    """Decorator: the function gets the named views instead of (spark, sf_dir)."""

    def wrap(f: Callable[..., DataFrame]):
        return lambda spark, sf_dir: f(*[view(spark, sf_dir, n) for n in names])

    return wrap


def _report(sql: str):
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


P, I, D, C = "payments", "invoices", "debtors", "credits"


def _prepared(payments: DataFrame) -> DataFrame:
    return signals.preprocess(payments)


@_views(P)
def n_labels(p):
    return p.select("seq", text.normalize_label(F.col("label")).alias("label_n"))


@_views(P)
def n_scalars(p):
    return p.select(
        "seq", text.normalize_ref(F.col("label")).alias("ref"), text.strip_leading_zeros(F.lpad(F.col("seq").cast("string"), 12, "0")).alias("bare"), text.pad_numeric(F.col("label")).alias("padded"),
        text.normalize_iban(F.lower("iban")).alias("iban_n"), text.detect_language(F.col("label")).alias("lang"), text.collapse_spaces(F.replace(F.col("label"), F.lit("-"), F.lit("  "))).alias("spaced"),
        text.normalize_currency(F.when(F.col("seq") % 3 == 0, "€").when(F.col("seq") % 3 == 1, "usd").otherwise("XXX")).alias("cur"),
    )


@_views(P)
def n_amounts(p):
    whole, cents = F.floor(F.col("x") / 100).cast("string"), F.lpad((F.col("x") % 100).cast("string"), 2, "0")
    raw = F.when(F.col("seq") % 3 == 0, F.concat(whole, F.lit(","), cents)).when(F.col("seq") % 3 == 1, F.concat(whole, F.lit("."), cents)).otherwise(F.concat(F.lit("EUR "), whole))
    return p.select("seq", text.normalize_amount(raw).alias("amount"))


@_views(P)
def n_dates(p):
    raw = F.when(F.col("seq") % 3 == 0, F.date_format("day", "dd/MM/yyyy")).when(F.col("seq") % 3 == 1, F.date_format("day", "dd.MM.yy")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    return p.select("seq", text.normalize_date(raw).alias("date"))


@_views(P)
def n_ngrams(p):
    return p.select("seq", F.explode(text.char_ngrams(F.col("label"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@_views(P)
def e_signals(p):
    s = _prepared(p)
    return s.select("seq", F.concat_ws(",", "refs").alias("refs"), F.concat_ws(",", "periods").alias("periods"), "label_class", F.round("label_quality", 6).alias("label_quality"), "fingerprint", F.element_at("keywords", "partial").alias("partial"))


@_views(P)
def m_entities(p):
    e = p.select("seq", F.explode(signals.entities(F.upper("label"))).alias("e"))
    return e.select("seq", "e.entity_type", "e.value")


@_views(P, I)
def f_similarities(p, i):
    """Every pair of a debtor."""
    pair = p.join(i.select("did", "ord", "reference"), "did")
    a, b = text.deaccent(F.upper("label")), F.col("reference")
    r = lambda c: F.round(c, 6)
    return pair.select("seq", "ord", r(similarity.levenshtein_ratio(a, b)).alias("lev"), r(similarity.token_sort_ratio(a, b)).alias("tsort"), r(similarity.token_set_ratio(a, b)).alias("tset"), r(similarity.ngram_jaccard(a, b)).alias("grams"), r(similarity.jaro_winkler(a, b)).alias("jw"))


@_views(P, I)
def f_composite(p, i):
    pair = p.join(i.select("did", "ord", "reference"), "did")
    a, b = text.normalize_ref(F.col("label")), text.normalize_ref(F.col("reference"))
    return pair.select("seq", "ord", F.round(similarity.composite(a, b), 6).alias("score"), F.round(similarity.lcs_ratio(a, b), 6).alias("lcs"), F.round(similarity.partial_ratio(a, b), 6).alias("part"), F.round(similarity.numeric_ref_similarity(a, b), 6).alias("num"))


def _with_refs(payments: DataFrame) -> DataFrame:
    """References as a caller injects them: the order's own, taken from the payment's number."""
    own = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("FAC-"), F.year(F.date_sub("day", 30 + F.col("seq").cast("int") % 11)).cast("string"), F.lit("-"), F.lpad(F.col("seq").cast("string"), 8, "0"))).otherwise(F.concat(F.lit("INV"), F.col("seq").cast("string")))
    number = F.concat(F.when(F.col("seq") % 4 == 0, "PO").otherwise("BL"), F.lpad(F.floor(F.col("seq") / 8).cast("string"), 6, "0"))
    return payments.withColumn("refs", F.array(own, number))


def _grouped(f):
    @_views("grouped", I, D, C)
    def run(g, i, d, c):
        return f(g, i, d, c)

    return run


def _balance_payments(i: DataFrame, c: DataFrame) -> DataFrame:
    """A payment per debtor of all that is open, less credit notes where the debtor's number is even."""
    b = exact.balances(i, c)
    return b.select(F.col("did").alias("seq"), "did", (F.col("s") - F.when(F.col("did") % 2 == 0, F.col("c")).otherwise(0)).alias("x"))


@_views(P, I, D)
def l_features(p, i, d):
    f = scoring.pair_features(scoring.candidate_pairs(_prepared(p), i, d))
    return f.select("seq", "ord", *[F.round(c, 6).alias(c) for c in ("abs_diff", "ratio", "exact", "ht_exact", "log_x", "n_refs", "days_due", "over_due", "same_month", "day_of_month", "weekday", "risk", "avg_delay", "has_discount")])


@_views(P, I)
def l_rank(p, i):
    pair = p.join(i.select("did", "ord", "a", "due"), "did").select("seq", "ord", "x", "a", F.lit(True).alias("same_debtor"), F.datediff("day", "due").alias("days_due"), F.lit(0.0).alias("ref"), F.lit(0.0).alias("p"))
    return scoring.rank_candidates(pair).select("seq", "ord", "score", "rank")


@_views("grouped", I)
def l_combinations(g, i):
    pair = g.join(i.select("did", "ord", "a"), "did").select("seq", "ord", "x", "a", (1 / (1 + F.col("ord") % 7)).alias("p"))
    out = scoring.combinations(pair)
    return out.select("seq", F.concat_ws(",", F.transform("set", lambda v: v.cast("string"))).alias("members"), "score", "rank")


def l_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i, d = (view(spark, sf_dir, n) for n in (P, I, D))
    rows = scoring.pair_features(scoring.candidate_pairs(_prepared(p), i, d)).withColumn("label", (F.col("seq") == F.col("ord")).cast("double"))
    rows = cut(rows, "pairs")  # learning reads them many times
    model = scoring.train_ensemble(rows)
    p = scoring.predict(model, rows)
    best = tolerance.first_per_payment(p.withColumn("neg", -F.col("p")), "neg", "ord")
    return best.groupBy((F.col("seq") == F.col("ord")).alias("is_right")).agg(F.count(F.lit(1)).alias("n"))


def l_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, P)
    return scoring.population_stability(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), "x")


@_views(P, I)
def l_active(p, i):
    rows = p.select("seq", (F.col("x") % 1000 / 1000.0).alias("p"))
    return scoring.active_learning(rows, 50).select("seq", "p")


def cascade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.cascade(*[view(spark, sf_dir, n) for n in (P, I, D, C)])


def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade_rows(spark, sf_dir).groupBy("layer", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("ords"))


AS_OF = "2001-12-31"


@_views("grouped", P)
def r5_invoices(g, p):
    """Invoices per payment: single payments have one, grouped ones their n."""
    every = p.select("did", F.lit(1).alias("n")).unionByName(g.select("did", "n"))
    return every.groupBy("did").agg(F.round(F.avg("n"), 6).alias("mean_n"), F.max("n").alias("max_n"), F.round(F.avg((F.col("n") > 1).cast("int")), 6).alias("share"))


@_views(P, I)
def x4_depletion(p, i):
    return sequential.deplete(p, i)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cascade": cascade_counts,
    "n_labels": n_labels, "n_scalars": n_scalars, "n_amounts": n_amounts, "n_dates": n_dates, "n_ngrams": n_ngrams, "e_signals": e_signals, "m2_entities": m_entities,
    "f_similarities": f_similarities, "f_composite": f_composite,
    "t_tolerance": _views(P, I, D)(tolerance.tolerance),
    "k_credit_note": _views(P, I, C)(lambda p, i, c: tolerance.credit_note(p.withColumn("x", F.when(F.col("seq") % 10 == 9, F.col("x") - 123457).otherwise(F.col("x"))), i, c)),
    "k3_multi_credit": _views("grouped", I, C)(lambda g, i, c: tolerance.multi_credit(g.join(c.groupBy("did").agg(F.min_by("c", "cid").alias("c")), "did").select("seq", "did", (F.col("x") - F.col("c")).alias("x")), i, c)),
    "i1_installments": _views(P, I)(tolerance.installments),
    "j1_iso": _views(P, I)(lambda p, i: exact.r002_iso(p.select("*", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("INV"), F.col("seq").cast("string"))).alias("roc_ref"), F.lit("nothing").alias("rfb_ref"), F.when(F.col("seq") % 3 == 1, F.concat(F.lit("inv-"), F.lpad(F.col("seq").cast("string"), 8, "0"))).alias("inv_number"), F.lit(None).cast("string").alias("end_to_end_id"), F.lit(None).cast("string").alias("tx_id"), F.lit(None).cast("string").alias("bv_ref")), i)),
    "j2_reference": _views(P, I)(lambda p, i: exact.r001_reference(_with_refs(p), i)),
    "j3_variants": _views(P, I)(lambda p, i: exact.r003_variants(_with_refs(p), i)),
    "j4_variant_index": _views(I)(lambda i: exact.variant_index(i).groupBy("ord").agg(F.count(F.lit(1)).alias("n"))),
    "j6_unique_amount": _views(P, I)(exact.r004_unique_amount),
    "j7_full_balance": _views(I, C)(lambda i, c: exact.r004_full_balance(_balance_payments(i, c), i, c)),
    "j8_month": _views(P, I)(lambda p, i: exact.r004_month(p.withColumn("day", F.date_sub("day", 28)), i)),
    "j9_batch": _views(I)(lambda i: exact.r004_batch(i.groupBy("did", "issue").agg(F.sum("a").alias("x"), F.min("ord").alias("seq")), i)),
    "j10_balance": _views(I, C)(lambda i, c: exact.r005_balance(_balance_payments(i, c), i, c)),
    "j11_order_number": _views(P, I)(lambda p, i: exact.r006_order(_with_refs(p), i)),
    "j12_delivery_number": _views(P, I)(lambda p, i: exact.r007_delivery(_with_refs(p), i)),
    "b2_hypotheses": _grouped(lambda g, i, d, c: cb.hypotheses(g, d, c).select("seq", "h", "rule", "target", "tol")),
    "b4_two_sum": _grouped(lambda g, i, d, c: cb.two_sum(cb.hypotheses(g, d).where("h <= 1"), cb.largest_invoices(i)).select("seq", "h", "i", "j", "s")),
    "b5_greedy": _grouped(lambda g, i, d, c: cb.greedy(cb.hypotheses(g, d).where("h <= 1"), cb.largest_invoices(i)).select("seq", "h", "n", "s")),
    "b6_meet_in_the_middle": _grouped(lambda g, i, d, c: cb.meet_in_the_middle(cb.hypotheses(g, d).where("h <= 1"), cb.largest_invoices(i)).select("seq", "h", "n", "s")),
    "b3_subset_sum": _grouped(lambda g, i, d, c: cb.subset_sum(g, i, d, c)),
    "b7_period_groups": _grouped(lambda g, i, d, c: cb.period_groups(g, i)),
    "p1_delay_pattern": _views(P, I, D)(temporal.delay_pattern),
    "p2_label_period": _views(P, I)(lambda p, i: temporal.label_period_sum(_prepared(p.withColumn("label", F.concat(F.lit("FACTURES "), F.upper(F.date_format(F.date_sub("day", 30 + F.col("seq").cast("int") % 11), "MMMM yyyy"))))), i)),
    "d1_duplicates": _views(P)(lambda p: temporal.duplicates(_prepared(p.unionByName(p.where("seq % 50 = 0").withColumn("seq", F.col("seq") + 20000000))))),
    "d2_near_duplicates": _views(P)(lambda p: temporal.near_duplicates(p.unionByName(p.where("seq % 50 = 0").select((F.col("seq") + 20000000).alias("seq"), "did", F.date_add("day", 1).alias("day"), (F.col("x") + 20).alias("x"), "iban", "label")))),
    "m1_fuzzy": _views(P, I)(lambda p, i: fuzzy.fuzzy_reference(_prepared(p), i)),
    "m3_combined": _views(P, I)(lambda p, i: fuzzy.combined_evidence(_prepared(p), i)),
    "m4_tfidf_idf": _views(I)(lambda i: fuzzy.tfidf_fit(i).select("g", F.round("idf", 9).alias("idf"))),
    "m5_tfidf_top": _views(P, I)(lambda p, i: fuzzy.tfidf_top(_prepared(p), i).select("seq", "ord", "cos", "k")),
    "m6_tfidf_match": _views(P, I)(lambda p, i: fuzzy.tfidf_match(_prepared(p), i)),
    "l1_features": l_features, "l6_ensemble": l_ensemble, "l9_active_learning": l_active, "l10_psi": l_psi, "l12_rank": l_rank, "l13_combinations": l_combinations,
    "q2_best_candidate": _views(P, I, D)(lambda p, i, d: review.best_candidate(review.candidates(p, i, d))),
    "q3_queue": _views(P, I, D)(lambda p, i, d: review.queue_places(review.queue(p, i, d, AS_OF))),
    "q4_next_item": _views(P, I, D)(lambda p, i, d: review.next_items(review.queue(p, i, d, AS_OF), 20, p.where("x > 40000000"))),
    "r5_invoices_per_payment": r5_invoices, "x4_depletion": x4_depletion, "r9_top_tokens": _views(P)(profiler.top_tokens), "r9_label_profile": _views(P)(profiler.label_profile),
    **{name: _report(sql) for name, sql in REPORTS.items()},
}

ORACLE_SQL: dict[str, str] = {"t_tolerance": oracle(TOLERANCE), **{k: oracle(v) for k, v in QUEUES.items()}, **{k: oracle(v) for k, v in REPORTS.items()}, **{k: oracle(v) for k, v in ORACLES.items()}}
