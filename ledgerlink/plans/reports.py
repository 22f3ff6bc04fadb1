"""Reporting, review, profile and monitoring queries over the tolerance results; one SQL text each, for Spark and for the oracle."""

from __future__ import annotations

from ..config import BTP_RETENTION_PERCENT, INSTALLMENT_PERCENT, SEPA_COUNTRIES, WITHHOLDING_PERCENT


def _chain(value) -> str:
    """CASE over the bands; value(rule, confidence, flag, allocated) is what a band gives."""
    band = lambda p, w: f"abs(1000 * x - 10 * a * (100 - {p})) < {w} * a"
    left = lambda p: f"a * (100 - {p}) div 100"
    sepa = ", ".join(f"'{c}'" for c in SEPA_COUNTRIES)
    arms = [
        ("x <> a AND abs(x - a) <= 100", "R-M004", "0.99e0", "ROUNDING", "x"),
        (f"country IS NOT NULL AND country NOT IN ({sepa}) AND x - a >= -3500 AND x < a", "R-M001", "0.95e0", "SWIFT_FEES", "x"),
        ("upper(label) LIKE '%OUR%' AND x - a >= -1500 AND x < a", "R-M002", "0.96e0", "SEPA_OUR_FEES", "x"),
        (f"discount_pct > 0 AND {band('discount_pct', 5)}", "R-M003", "0.97e0", "DISCOUNT_APPLIED", left("discount_pct")),
        (f"retention_pct > 0 AND {band('retention_pct', 5)}", "R-M005", "0.93e0", "RETENTION_APPLIED", left("retention_pct")),
        *[(f"sector = 'BTP' AND {band(p, 5)}", "R-M005", "0.91e0", "RETENTION_BTP", left(p)) for p in BTP_RETENTION_PERCENT],
        (f"rfa_pct > 0 AND {band('rfa_pct', 5)}", "R-M009", "0.91e0", "RFA_DEDUCTED", left("rfa_pct")),
        *[(f"country = '{c}' AND {band(p, 10)}", "R-M010", "0.90e0", "WITHHOLDING_TAX", left(p)) for c, p in WITHHOLDING_PERCENT.items()],
        *[(band(100 - p, 10), "R-M012", "0.88e0", f"INSTALLMENT_{p}PCT", "x") for p in INSTALLMENT_PERCENT],
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {value(*rest)}" for c, *rest in arms) + " END"


TOLERANCE = f"""
SELECT seq, ord, rule, CAST(conf AS double) AS confidence, flag, CAST(allocated AS bigint) AS allocated FROM (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ord) AS rn FROM (
    SELECT seq, ord, {_chain(lambda r, c, f, a: f"'{r}'")} AS rule, {_chain(lambda r, c, f, a: c)} AS conf,
      {_chain(lambda r, c, f, a: f"'{f}'")} AS flag, {_chain(lambda r, c, f, a: a)} AS allocated
    FROM payments p JOIN invoices i USING (did) LEFT JOIN (SELECT did, country, sector, discount_pct, retention_pct, rfa_pct FROM debtors) d USING (did)
  ) t WHERE rule IS NOT NULL) r WHERE rn = 1
"""

#: Report rows: every payment with its best tolerance result; 6 and HUMAN_REVIEW where there is none.
RESULTS = f"""results AS (
  SELECT p.seq, p.did, p.day, p.x, p.label, d.country, d.sector, d.risk_pct, coalesce(t.rule, 'HUMAN_REVIEW') AS method, coalesce(t.confidence, 0.0e0) AS confidence,
    coalesce(t.flag, '') AS flags, t.ord, t.rule IS NOT NULL AND t.confidence >= 0.90e0 AS matched, CASE WHEN t.rule IS NOT NULL AND t.confidence >= 0.90e0 THEN 2 ELSE 6 END AS layer
  FROM payments p LEFT JOIN ({TOLERANCE}) t ON p.seq = t.seq LEFT JOIN debtors d ON p.did = d.did)"""


def _over(sql: str) -> str:
    return f"WITH {RESULTS} {sql}"


RATE = "round(100.0e0 * sum(CASE WHEN matched THEN 1 ELSE 0 END) / count(*), 1)"

REPORTS = {
    "a1_monthly": _over(f"SELECT CAST(year(day) AS int) AS y, CAST(month(day) AS int) AS m, count(*) AS n, CAST(sum(CASE WHEN matched THEN 1 ELSE 0 END) AS bigint) AS auto_n, {RATE} AS auto_rate FROM results GROUP BY year(day), month(day)"),
    "a2_top_methods": _over("SELECT method, count(*) AS n FROM results WHERE matched GROUP BY method ORDER BY n DESC, method LIMIT 10"),
    "a3_debtor_scorecard": _over(f"SELECT did, country, sector, count(*) AS n, CAST(sum(CASE WHEN matched THEN 1 ELSE 0 END) AS bigint) AS auto_n, CAST(sum(x) AS bigint) AS cents, round(avg(confidence), 6) AS mean_confidence, {RATE} AS auto_rate FROM results GROUP BY did, country, sector"),
    "a4_country_scorecard": _over(f"SELECT country, count(*) AS n, CAST(sum(x) AS bigint) AS cents, {RATE} AS auto_rate FROM results GROUP BY country"),
    "a5_debtor_layer_matrix": _over("SELECT did, count(CASE WHEN layer = 2 THEN 1 END) AS c2, count(CASE WHEN layer = 6 THEN 1 END) AS c6 FROM results GROUP BY did"),
    "a6_confidence_histogram": _over("SELECT CAST(least(24, floor((confidence - 0.88e0) / 0.0044e0 + 0.000001e0)) AS int) AS bin, count(*) AS n FROM results WHERE confidence > 0 GROUP BY least(24, floor((confidence - 0.88e0) / 0.0044e0 + 0.000001e0))"),
    "a7_flag_frequency": _over("SELECT flags AS flag, count(*) AS n FROM results WHERE flags <> '' GROUP BY flags ORDER BY n DESC, flag LIMIT 15"),
    "a8_layer_kpis": _over("SELECT layer, count(*) AS n, CAST(sum(x) AS bigint) AS cents, round(avg(confidence), 6) AS mean_confidence FROM results GROUP BY layer"),
    "a9_filters": _over("SELECT seq, x, country FROM results WHERE country IN ('US', 'MA') AND x BETWEEN 1000000 AND 2000000 AND flags <> '' AND NOT matched"),
    "a10_mapping": _over("SELECT r.seq, r.method, i.reference, CASE WHEN r.matched THEN r.x - i.a END AS gap FROM results r LEFT JOIN invoices i ON r.ord = i.ord"),
    "a12_page": _over("SELECT seq, x, did FROM results ORDER BY x DESC, seq LIMIT 20 OFFSET 40"),
    "a13_quarterly": _over("SELECT CAST(year(day) AS int) AS y, CAST(quarter(day) AS int) AS q, count(*) AS n, CAST(sum(CASE WHEN confidence >= 0.90e0 THEN 1 ELSE 0 END) AS bigint) AS auto_n FROM results GROUP BY year(day), quarter(day)"),
    "a13_top_debtors": _over("SELECT did, count(*) AS n, CAST(sum(x) AS bigint) AS cents FROM results GROUP BY did ORDER BY cents DESC, did LIMIT 20"),
    "a14_totals": _over("SELECT count(DISTINCT did) AS debtors, count(DISTINCT method) AS methods, CAST(sum(x) AS bigint) AS cents, count(*) AS n FROM results"),
    "a15_catalogue": _over("SELECT method, seq, k FROM (SELECT method, seq, row_number() OVER (PARTITION BY method ORDER BY confidence DESC, seq) AS k FROM results) c WHERE k <= 50"),
    "q1_priority": _over(
        "SELECT seq, round(0.3e0 * least(x / 10000000.0e0, 1.0e0) + 0.25e0 * least(datediff(d0, day) / 30.0e0, 1.0e0) + 0.25e0 * CASE WHEN confidence > 0 THEN 1 - least(abs(confidence - 0.90e0) / 0.5e0, 1.0e0) ELSE 0.3e0 END + 0.2e0 * risk_pct / 100.0e0, 6) AS priority "
        "FROM (SELECT *, CAST('2001-12-31' AS date) AS d0 FROM results) r WHERE NOT matched"
    ),
    "q5_feedback": _over(
        "SELECT seq, decision, CASE WHEN decision = 'APPROVE' AND ord IS NOT NULL THEN 1.0e0 END AS confidence, CASE WHEN decision = 'APPROVE' AND ord IS NOT NULL THEN 'HUMAN_APPROVED' WHEN decision = 'CORRECT' THEN 'HUMAN_CORRECTED' END AS flag "
        "FROM (SELECT *, CASE CAST(seq % 6 AS int) WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'CORRECT' WHEN 2 THEN 'REJECT' WHEN 3 THEN 'SPLIT' WHEN 4 THEN 'DEFER' ELSE 'ESCALATE' END AS decision FROM results WHERE NOT matched) r"
    ),
    "q6_review_view": "SELECT did, seq, ord, a FROM (SELECT p.did, p.seq, i.ord, i.a, row_number() OVER (PARTITION BY p.seq ORDER BY i.ord) AS k FROM payments p JOIN invoices i ON p.did = i.did) t WHERE k <= 50",
    "q7_review_stats": _over(
        "SELECT count(*) AS n, count(CASE WHEN seq % 6 = 0 THEN 1 END) AS approved, count(CASE WHEN seq % 6 = 1 THEN 1 END) AS corrected, count(CASE WHEN seq % 6 = 2 THEN 1 END) AS rejected, "
        "round(1.0e0 * count(CASE WHEN seq % 6 = 0 THEN 1 END) / count(*), 6) AS approval_rate FROM results WHERE NOT matched"
    ),
    "r2_amount_stats": "SELECT did, count(*) AS n, round(avg(x), 3) AS mean_x, min(x) AS min_x, max(x) AS max_x, round(stddev_pop(x), 3) AS std_x, round(greatest(0, avg(x) - 2 * stddev_pop(x)), 3) AS low_x, round(avg(x) + 2 * stddev_pop(x), 3) AS high_x FROM payments GROUP BY did",
    "r3_pay_days": "SELECT did, dom, n FROM (SELECT did, dom, n, row_number() OVER (PARTITION BY did ORDER BY n DESC, dom) AS k, sum(n) OVER (PARTITION BY did) AS t FROM (SELECT did, CAST(day(day) AS int) AS dom, count(*) AS n FROM payments GROUP BY did, day(day)) c) d WHERE k <= 3 AND n >= 0.15e0 * t",
    "r4_delays": _over("SELECT r.did, round(avg(datediff(r.day, i.due)), 6) AS mean_delay, round(stddev_pop(datediff(r.day, i.due)), 6) AS std_delay FROM results r JOIN invoices i ON r.ord = i.ord WHERE r.matched GROUP BY r.did"),
    "r6_method_distribution": _over("SELECT did, method, count(*) AS n, round(1.0e0 * count(*) / sum(count(*)) OVER (PARTITION BY did), 6) AS share FROM results WHERE matched GROUP BY did, method"),
    "r7_flag_rates": _over("SELECT did, round(1.0e0 * sum((length(flags) - length(replace(flags, 'RETENTION', ''))) div 9) / count(*), 6) AS retention, round(1.0e0 * sum((length(flags) - length(replace(flags, 'DISCOUNT', ''))) div 8) / count(*), 6) AS discount FROM results GROUP BY did"),
    "r8_layer_distribution": _over(f"SELECT did, layer, count(*) AS n FROM results GROUP BY did, layer"),
    "r11_anomalies": "SELECT p.seq, p.did FROM payments p JOIN (SELECT did, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM payments GROUP BY did) b ON p.did = b.did WHERE b.n >= 10 AND (p.x > b.m + 2 * b.s OR p.x < 0.5e0 * (b.m - 2 * b.s))",
    "r12_suggestions": "SELECT seq, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, ord) AS k FROM (SELECT p.seq, i.ord, CASE WHEN p.x = i.a THEN 35 WHEN 20 * abs(p.x - i.a) < i.a THEN 25 WHEN 5 * abs(p.x - i.a) < i.a THEN 10 ELSE 0 END + CASE WHEN abs(datediff(p.day, i.due)) <= 5 THEN 25 WHEN abs(datediff(p.day, i.due)) <= 15 THEN 10 ELSE 0 END + 20 AS score FROM payments p JOIN invoices i ON p.did = i.did) s WHERE score > 10) t WHERE k <= 5",
    "o6_monitoring": _over("SELECT count(*) AS n, round(1.0e0 * sum(CASE WHEN matched THEN 1 ELSE 0 END) / count(*), 6) AS auto_rate, CAST(sum(CASE WHEN matched THEN 0 ELSE 1 END) AS bigint) AS backlog, round(1.0e0 * sum(CASE WHEN matched AND ord = seq THEN 1 ELSE 0 END) / sum(CASE WHEN matched THEN 1 ELSE 0 END), 6) AS prec FROM results"),
    "o7_by_layer": _over("SELECT l.layer, count(r.seq) AS n FROM (SELECT 0 AS layer UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) l LEFT JOIN results r ON r.layer = l.layer GROUP BY l.layer"),
    "o7_by_method": _over("SELECT method, count(*) AS n, CAST(sum(ord) AS bigint) AS ords FROM results GROUP BY method"),
    "o4_should_retrain": _over("SELECT CASE WHEN count(CASE WHEN NOT matched THEN 1 END) >= 100 THEN 'feedback' ELSE 'none' END AS reason FROM results"),
    "o1_feedback": _over("SELECT seq, ord = seq AS is_correct FROM results WHERE matched"),
    "b1_largest_15": "SELECT did, ord, pos FROM (SELECT did, ord, row_number() OVER (PARTITION BY did ORDER BY a DESC, ord) - 1 AS pos, count(*) OVER (PARTITION BY did) AS n FROM invoices) t WHERE pos < 15 AND n >= 2",
    "r10_boost": _over(
        "SELECT r.seq, round(greatest(-0.10e0, least(0.10e0, CASE WHEN m.share > 0.3e0 THEN 0.03e0 WHEN m.share < 0.05e0 THEN -0.02e0 ELSE 0e0 END + CASE WHEN r.x BETWEEN p.m - 2 * p.s AND p.m + 2 * p.s THEN 0.02e0 WHEN r.x > 1.5e0 * (p.m + 2 * p.s) THEN -0.03e0 ELSE 0e0 END)), 6) AS boost "
        "FROM results r JOIN (SELECT did, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM results GROUP BY did) p ON r.did = p.did "
        "JOIN (SELECT did, method, 1e0 * count(*) / sum(count(*)) OVER (PARTITION BY did) AS share FROM results GROUP BY did, method) m ON r.did = m.did AND r.method = m.method WHERE p.n >= 5"
    ),
    "a11_recommendations": _over(
        "SELECT seq, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, ord) AS k FROM (SELECT r.seq, i.ord, CASE WHEN r.x = i.a THEN 40 WHEN r.x = i.ht THEN 35 WHEN 20 * abs(r.x - i.a) < i.a THEN 30 WHEN 5 * abs(r.x - i.a) < i.a THEN 15 ELSE 0 END "
        "+ 25 + CASE WHEN abs(datediff(r.day, i.due)) <= 7 THEN 20 WHEN abs(datediff(r.day, i.due)) <= 30 THEN 10 ELSE 0 END AS score FROM (SELECT * FROM results WHERE NOT matched) r JOIN invoices i ON r.did = i.did) s WHERE score > 10) t WHERE k <= 5"
    ),
}

_FOUND = f"""found AS (SELECT seq, ord, {_chain(lambda r, c, f, a: f"'{r}'")} AS rule, CAST({_chain(lambda r, c, f, a: c)} AS double) AS confidence
  FROM payments p JOIN invoices i USING (did) LEFT JOIN (SELECT did, country, sector, discount_pct, retention_pct, rfa_pct FROM debtors) d USING (did)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY confidence DESC, ord) AS k FROM found WHERE rule IS NOT NULL) b WHERE k = 1)"""
_QUEUE = f"""{_FOUND}, queue AS (SELECT p.seq, p.did, round(0.3e0 * least(p.x / 10000000e0, 1e0) + 0.25e0 * coalesce(least(datediff(d0, day) / 30e0, 1e0), 0.5e0)
  + 0.25e0 * CASE WHEN b.confidence IS NOT NULL THEN 1 - least(abs(b.confidence - 0.90e0) / 0.5e0, 1e0) ELSE 0.3e0 END + 0.2e0 * coalesce(d.risk_pct / 100e0, 0.5e0), 6) AS priority, date_add(p.day, 1) AS deadline, p.x
  FROM (SELECT *, CAST('2001-12-31' AS date) AS d0 FROM payments) p LEFT JOIN best b ON p.seq = b.seq LEFT JOIN debtors d ON p.did = d.did WHERE b.confidence IS NULL OR b.confidence < 0.90e0)"""
#: The oracle's SQL of queries that are DataFrame code.
QUEUES = {
    "q2_best_candidate": f"WITH {_FOUND} SELECT seq, ord, rule, confidence FROM best",
    "q3_queue": f"WITH {_QUEUE} SELECT seq, did, priority, deadline, row_number() OVER (PARTITION BY did ORDER BY priority DESC, seq) AS place FROM queue",
    "q4_next_item": f"WITH {_QUEUE} SELECT seq, did, priority, deadline FROM queue WHERE x <= 40000000 ORDER BY priority DESC, seq LIMIT 20",
    "r5_invoices_per_payment": "SELECT did, round(avg(n), 6) AS mean_n, max(n) AS max_n, round(1e0 * count(CASE WHEN n > 1 THEN 1 END) / count(*), 6) AS share FROM (SELECT did, 1 AS n FROM payments UNION ALL SELECT did, n FROM grouped) e GROUP BY did",
}
