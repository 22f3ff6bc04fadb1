"""Scalar functions and rules on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlink.functions import signals, similarity, text
from ledgerlink.operators import assistant, combinatorial, scoring, tolerance


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first().v


@pytest.mark.parametrize(("raw", "want"), [("15.000,50", 15000.50), ("15,000.50", 15000.50), ("15000,50", 15000.50), ("12", 12.0), ("x", None), (None, None)])
def test_amounts(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "a string").select(text.normalize_amount(F.col("a")).alias("v")).first().v == want


@pytest.mark.parametrize(("raw", "want"), [("01/10/2024", dt.date(2024, 10, 1)), ("01-10-24", dt.date(2024, 10, 1)), ("01.10.75", dt.date(1975, 10, 1)), ("2024-10-01", dt.date(2024, 10, 1)), ("31/02/2024", None), ("", None)])
def test_dates(spark, raw, want):
    assert one(spark, text.normalize_date(F.col("d")), d=raw) == want


def test_labels(spark):
    f = lambda s: one(spark, text.normalize_label(F.col("x")), x=s)
    assert f("Virement reçu de  REGLT fac-2024/001") == "REGLEMENT FACTURE 2024 001"
    assert f("SCT SCT remise é") == "E" and f("") == ""
    assert one(spark, text.pad_numeric(F.col("x")), x="FAC12-1234567") == "FAC000012-1234567"
    assert one(spark, text.strip_leading_zeros(F.col("x")), x="000") == "0"
    assert one(spark, text.detect_language(F.col("x")), x="payment invoice") == "EN" and one(spark, text.detect_language(F.col("x")), x="?") == "FR"
    assert one(spark, text.normalize_currency(F.col("x")), x=" € ") == "EUR"
    assert one(spark, F.concat_ws(",", text.char_ngrams(F.col("x"), (3,))), x="a bcd") == "abc,bcd"
    assert one(spark, text.safe_float(F.col("x"), 7.0), x="q") == 7.0 and one(spark, text.safe_div(F.lit(1.0), F.lit(0.0), 5.0), x=1) == 5.0


def test_signals(spark):
    refs = lambda s: one(spark, signals.extract_refs(F.col("x")), x=s)
    assert refs("FACTURE 2024 001234 INV 000123") == ["FACTURE2024001234", "INV000123", "001234", "000123"]
    assert one(spark, signals.extract_periods(F.col("x")), x="MARS 2024 Q1") == ["MARS 2024", "Q1"]
    iso = {k: F.lit(v) for k, v in (("roc_ref", "R-1"), ("rfb_ref", "B"), ("inv_number", "I"), ("end_to_end_id", "b"))}
    assert one(spark, signals.merge_refs(F.array(F.lit("G1")), F.array(F.lit("I"), F.lit("N")), iso), x=1) == ["B", "R1", "G1", "I", "N"]
    assert one(spark, signals.entities(F.col("x")), x="CLT 12345 AVOIR 123")[0].entity_type == "DEBTOR_CODE"
    assert one(spark, signals.parse_iso20022(F.col("x"))["rfb_ref"], x='{"iso20022": {"EndToEndId": "E1"}}') == "E1"
    assert one(spark, signals.cents_text(F.col("x")), x=-1005) == "-10.05"


def test_similarities(spark):
    s = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert s(similarity.levenshtein_ratio, "", "") == 1.0 and s(similarity.levenshtein_ratio, "", "a") == 0.0
    assert s(similarity.numeric_ref_similarity, "FAC001234", "FAC1234") == 1.0 and s(similarity.numeric_ref_similarity, "FAC", "1") == 0.0
    assert s(similarity.partial_ratio, "abc", "xxabcxx") == 1.0
    assert s(similarity.token_sort_ratio, "b a", "a b") == 1.0 and s(similarity.token_set_ratio, "a b", "b c") == pytest.approx(1 / 3)
    assert s(similarity.lcs_ratio, "abcd", "abxd") == 0.75
    assert s(similarity.jaro_winkler, "MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert s(similarity.composite, "FAC1234", "FAC1234") == pytest.approx(1.0)
    assert s(similarity.ngram_jaccard, "ab", "ab") == 1.0 and one(spark, similarity.ocr_fix(F.col("a")), a="OIl") == "011"


CASES = [
    (10000_00, 10000_50, {}, "", "ROUNDING"), (14972_00, 15000_00, {"country": "US"}, "", "SWIFT_FEES"), (14995_00, 15000_00, {"country": "FR"}, "VIR OUR", "SEPA_OUR_FEES"),
    (9800_00, 10000_00, {"discount_pct": 2}, "", "DISCOUNT_APPLIED"), (19000_00, 20000_00, {"sector": "BTP"}, "", "RETENTION_BTP"), (9500_00, 10000_00, {"retention_pct": 5}, "", "RETENTION_APPLIED"),
    (9700_00, 10000_00, {"rfa_pct": 3}, "", "RFA_DEDUCTED"), (8000_00, 10000_00, {"country": "MA"}, "", "WITHHOLDING_TAX"), (9000_00, 30000_00, {}, "", "INSTALLMENT_30PCT"), (1_00, 10000_00, {}, "", None),
]


@pytest.mark.parametrize(("x", "a", "debtor", "label", "flag"), CASES)
def test_tolerance_bands(spark, x, a, debtor, label, flag):
    d = {"did": 1, "name": "n", "iban": "i", "country": None, "sector": "X", "discount_pct": 0, "retention_pct": 0, "rfa_pct": 0} | debtor
    debtors = spark.createDataFrame([tuple(d.values())], "did long, name string, iban string, country string, sector string, discount_pct int, retention_pct int, rfa_pct int")
    payments, invoices = spark.createDataFrame([(7, 1, x, label)], "seq long, did long, x long, label string"), spark.createDataFrame([(1, 3, a)], "did long, ord long, a long")
    got = tolerance.tolerance(payments, invoices, debtors).collect()
    assert [r.flag for r in got] == ([flag] if flag else [])


def test_subsets(spark):
    invoices = spark.createDataFrame([(1, i, a * 100) for i, a in enumerate((2500, 3700, 1800, 4200, 6100, 900))] + [(2, 50, 500000)], "did long, ord long, a long")
    asked = spark.createDataFrame([(1, 1, 0, "R", 12200_00, 1, 0.9), (2, 1, 0, "R", 4300_00, 1, 0.9), (3, 2, 0, "R", 5000_00, 1, 0.9)], "seq long, did long, h int, rule string, target long, tol int, confidence double")
    top = combinatorial.largest_invoices(invoices)
    assert {r.seq: r.n for r in combinatorial.meet_in_the_middle(asked, top).collect()}[1] in (3, 4)
    assert {r.seq: r.s for r in combinatorial.two_sum(asked, top).collect()} == {2: 4300_00}
    assert all(r.s == 12200_00 for r in combinatorial.meet_in_the_middle(asked, top).where("seq = 1").collect())


def test_drift_and_sampling(spark):
    a, b = spark.range(1000).select((F.col("id") % 100).alias("v")), spark.range(1000).select((F.col("id") % 100 + 50).alias("v"))
    assert scoring.population_stability(a, a, "v").first().psi == 0.0 and scoring.population_stability(a, b, "v").first().psi > 0.2
    assert scoring.population_stability(a.limit(0), b.limit(0), "v").first().psi == 0.0
    rows = spark.createDataFrame([(i, i / 10) for i in range(11)], "seq long, p double")
    assert [r.seq for r in scoring.active_learning(rows, 1).collect()] == [5] and scoring.active_learning(rows, 4, "hybrid").count() == 2


def test_assistant(spark):
    assert assistant.extract_json('text ```json\n{"a": 1}\n``` x') == {"a": 1} and assistant.extract_json('so {"a": "}"} end') == {"a": "}"} and assistant.extract_json("none") is None
    rows = [(100_00, ["A"], [100_00], {"A": 100_00}, 0.9, "why"), (100_00, ["B"], [200_00], {"A": 100_00}, 1.0, "")]
    df = spark.createDataFrame(rows, "x long, refs array<string>, allocated array<long>, amounts map<string,long>, confidence double, reasoning string")
    assert [r.errors for r in assistant.validate(df).orderBy("confidence").collect()] == [[], ["UNKNOWN_REFERENCE", "BAD_ALLOCATION", "OVER_ALLOCATED", "TOO_SURE", "NO_REASONING"]]
    prompts = spark.createDataFrame([("p",), ("p",), ("q",)], "prompt string")
    assert sorted(r.answer for r in assistant.ask(prompts, lambda p: p + "!").collect()) == ["p!", "q!"] and assistant.ask(prompts, None).where("answer is null").count() == 2
    calls = spark.createDataFrame([("m-large", 1000, 500), ("m-large", 1000, 500)], "model string, tokens_in long, tokens_out long")
    assert assistant.usage(calls, {"m": (1.0, 2.0)}).first().cost == 4.0
    assert one(spark, assistant.route(F.col("c"), F.lit(2)), c="CRYPTIC") == "cryptic"


def test_streams(spark, sf_dir, tmp_path):
    from ledgerlink.streaming.payments import duplicate_stream, run_to_table, windowed_counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run_to_table(windowed_counts(stream, "event_type"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): r.n for r in windowed_counts(events, "event_type").collect()}
    last = max(s for s, _ in want)
    assert {k: v for k, v in want.items() if k[0] < last} == {k: v for k, v in got.items() if k[0] < last}
    keyed = stream.select("ts", F.col("user_id").cast("string").alias("fingerprint"))
    run_to_table(duplicate_stream(keyed, "60 days"), str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == events.select("user_id").distinct().count()
