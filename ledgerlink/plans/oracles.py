"""SQL of the DataFrame operators, for the oracle's engine; the derived views are added by fixtures.oracle()."""

from __future__ import annotations

from ..config import ABBREVIATIONS, BANK_PREFIXES, ENTITY_PATTERNS, KEYWORDS, LANGUAGE_WORDS, PERIOD_PATTERNS, REF_PATTERNS, REF_PREFIXES


def _list(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items()) + "}"
LABEL = (
    "array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(strip_accents(upper(label))), '^(?:(?:"
    + "|".join(BANK_PREFIXES)
    + rf")\s*){{1,5}}', '')), '[^A-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: coalesce(({_MAP})[t], t)), ' ')"
)
NORM = lambda c: f"regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"
#: The engine has no look-behind: the characters around a number are matched instead.
_PATTERNS = [p if "?<!" not in p else r"(?:^|[^A-Za-z0-9])(\d{6,10})(?:[^0-9]|$)" for p in REF_PATTERNS]
_ALL_REFS = "list_concat(" + ", list_concat(".join(f"regexp_extract_all(label_n, '{p}', 1)" for p in _PATTERNS[:-1]) + f", regexp_extract_all(label_n, '{_PATTERNS[-1]}', 1)" + ")" * (len(_PATTERNS) - 1)
_ALL_PERIODS = "list_concat(" + ", list_concat(".join(f"regexp_extract_all(label_n, '{p}', 0)" for p in PERIOD_PATTERNS[:-1]) + f", regexp_extract_all(label_n, '{PERIOD_PATTERNS[-1]}', 0)" + ")" * (len(PERIOD_PATTERNS) - 1)
_KEYS = " + ".join(f"CASE WHEN regexp_matches(label_n, '{'|'.join(w)}') THEN 1 ELSE 0 END" for w in KEYWORDS.values())
_PARTIAL = "|".join(KEYWORDS["partial"])

SIGNALS = f"""sig AS (SELECT *, list_filter(r0, lambda v, i: list_position(r0, v) = i) AS refs FROM (
  SELECT *, list_filter(list_transform({_ALL_REFS}, lambda v: {NORM('v')}), lambda v: length(v) >= 3) AS r0,
    list_transform({_ALL_PERIODS}, lambda v: trim(upper(v))) AS periods FROM (SELECT *, {LABEL} AS label_n FROM payments) a) b)"""

_LANG = {k: " + ".join(f"CASE WHEN contains(upper(label), '{w}') THEN 1 ELSE 0 END" for w in v) for k, v in LANGUAGE_WORDS.items()}
_BEST = "greatest(" + ", ".join(_LANG.values()) + ")"
LANGUAGE = f"CASE WHEN {_BEST} = 0 THEN 'FR' " + " ".join(f"WHEN {s} = {_BEST} THEN '{k}'" for k, s in _LANG.items()) + " END"

_OWN = "CASE WHEN seq % 2 = 0 THEN 'FAC' || CAST(year(day - CAST(30 + seq % 11 AS int)) AS varchar) || lpad(CAST(seq AS varchar), 8, '0') ELSE 'INV' || CAST(seq AS varchar) END"
_NUMBER = "CASE WHEN seq % 4 = 0 THEN 'PO' ELSE 'BL' END || lpad(CAST(seq // 8 AS varchar), 6, '0')"
REFS = f"refs AS (SELECT seq, did, x, 0 AS pos, {_OWN} AS ref FROM payments UNION ALL SELECT seq, did, x, 1 AS pos, {_NUMBER} AS ref FROM payments)"
_REF_I = NORM("reference")
BYREF = f"byref AS (SELECT ref, ord, did, a, ht FROM (SELECT {_REF_I} AS ref, ord, did, a, ht, row_number() OVER (PARTITION BY {_REF_I} ORDER BY ord DESC) AS k FROM invoices) t WHERE k = 1)"


def _variants() -> str:
    out = ["norm"] + [f"CASE WHEN num <> '' THEN '{p}' || num END" for p in REF_PREFIXES]
    for n in range(4, 9):
        pad = f"CASE WHEN length(bare) < {n} THEN lpad(bare, {n}, '0') ELSE bare END"
        out += [f"CASE WHEN bare <> '' THEN {pad} END"] + [f"CASE WHEN bare <> '' THEN '{p}' || {pad} END" for p in REF_PREFIXES[:5]]
    for y in ("CAST(year(issue) AS varchar)", "CAST(year(issue) - 1 AS varchar)", "substring(CAST(year(issue) AS varchar), 3)"):
        out += [f"CASE WHEN num <> '' THEN {y} || num END", f"CASE WHEN num <> '' THEN num || {y} END"]
    return "[" + ", ".join(out) + "]"


VARIANTS = f"""variants AS (SELECT ref, ord, did, a FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY ord) AS k FROM (
  SELECT DISTINCT unnest({_variants()}) AS ref, ord, did, a FROM (
    SELECT *, regexp_replace(num, '^0+', '') AS bare FROM (SELECT *, regexp_replace(norm, '^[A-Z]+', '') AS num FROM (SELECT *, {_REF_I} AS norm FROM invoices) p) q) r) s WHERE ref IS NOT NULL) t WHERE k = 1)"""

BALANCES = "bal AS (SELECT i.did, i.n, i.s, coalesce(c.c, 0) AS c FROM (SELECT did, count(*) AS n, CAST(sum(a) AS bigint) AS s FROM invoices GROUP BY did) i LEFT JOIN (SELECT did, CAST(sum(c) AS bigint) AS c FROM credits GROUP BY did) c ON i.did = c.did)"
BALANCE_PAYMENTS = "bp AS (SELECT did AS seq, did, s - CASE WHEN did % 2 = 0 THEN c ELSE 0 END AS x FROM bal)"
TOP = "top AS (SELECT did, a, pos FROM (SELECT did, a, row_number() OVER (PARTITION BY did ORDER BY a DESC, ord) - 1 AS pos, count(*) OVER (PARTITION BY did) AS n FROM invoices) t WHERE pos < 15 AND n >= 2)"
ASKED = "asked AS (SELECT seq, did, 0 AS h, x AS target, 1 AS tol FROM grouped UNION ALL SELECT seq, did, 1 AS h, x AS target, 100 AS tol FROM grouped)"


def _number(column: str, rule: str, conf: str) -> str:
    return f"""WITH {REFS}, g AS (SELECT did, {NORM(column)} AS ref, CAST(sum(a) AS bigint) AS x, count(*) AS n, min(ord) AS ord FROM invoices WHERE {column} IS NOT NULL GROUP BY did, {NORM(column)})
    SELECT seq, ord, n, '{rule}' AS rule, CAST({conf} AS double) AS confidence FROM (SELECT r.seq, g.ord, g.n, row_number() OVER (PARTITION BY r.seq ORDER BY pos) AS k FROM refs r JOIN g ON r.did = g.did AND r.ref = g.ref AND r.x = g.x) t WHERE k = 1"""


ORACLES: dict[str, str] = {
    "n_labels": f"SELECT seq, {LABEL} AS label_n FROM payments",
    "n_scalars": f"""SELECT seq, {NORM('label')} AS ref, CASE WHEN seq = 0 THEN '0' ELSE CAST(seq AS varchar) END AS bare,
      array_to_string(list_transform(regexp_extract_all(label, '(\\d+|\\D+)', 1), lambda r: CASE WHEN regexp_matches(r, '^\\d') AND length(r) < 6 THEN lpad(r, 6, '0') ELSE r END), '') AS padded,
      iban AS iban_n, {LANGUAGE} AS lang, trim(regexp_replace(replace(label, '-', '  '), '\\s+', ' ', 'g')) AS spaced, CASE seq % 3 WHEN 1 THEN 'USD' ELSE 'EUR' END AS cur FROM payments""",
    "n_amounts": "SELECT seq, CASE WHEN seq % 3 <> 2 THEN x / 100.0e0 END AS amount FROM payments",
    "n_dates": "SELECT seq, day AS date FROM payments",
    "n_ngrams": """SELECT g, count(*) AS n FROM (SELECT unnest(list_concat(list_concat(
      list_transform(range(1, greatest(length(c) - 1, 1)), lambda i: substring(c, i, 3)), list_transform(range(1, greatest(length(c) - 2, 1)), lambda i: substring(c, i, 4))), list_transform(range(1, greatest(length(c) - 3, 1)), lambda i: substring(c, i, 5)))) AS g
      FROM (SELECT regexp_replace(label, '\\s+', '', 'g') AS c FROM payments) a) b GROUP BY g""",
    "e_signals": f"""WITH {SIGNALS} SELECT seq, array_to_string(refs, ',') AS refs, array_to_string(periods, ',') AS periods,
      CASE WHEN length(trim(label_n)) < 3 THEN 'EMPTY' WHEN len(refs) = 1 AND len(periods) = 0 THEN 'SINGLE_REF' WHEN len(refs) > 1 THEN 'MULTI_REF' WHEN len(periods) > 0 AND len(refs) = 0 THEN 'PERIOD_ONLY'
        WHEN len(refs) > 0 AND len(periods) > 0 THEN 'MIXED' WHEN len(string_split(trim(label_n), ' ')) <= 2 THEN 'CRYPTIC' ELSE 'MIXED' END AS label_class,
      round(least(least(length(label_n) / 100e0, 0.2e0) + CASE WHEN len(refs) > 0 THEN 0.2e0 + least(len(refs) * 0.05e0, 0.1e0) ELSE 0e0 END + CASE WHEN len(periods) > 0 THEN 0.15e0 ELSE 0e0 END + least(({_KEYS}) * 0.05e0, 0.2e0), 1e0), 6) AS label_quality,
      sha256(iban || '|' || CASE WHEN x < 0 THEN '-' ELSE '' END || CAST(abs(x) // 100 AS varchar) || '.' || lpad(CAST(abs(x) % 100 AS varchar), 2, '0') || '|' || CAST(day AS varchar) || '|' || label_n) AS fingerprint,
      regexp_matches(label_n, '{_PARTIAL}') AS partial FROM sig""",
    "m2_entities": " UNION ALL ".join(f"SELECT seq, '{k}' AS entity_type, unnest(regexp_extract_all(upper(label), '{p}', 1)) AS value FROM payments" for k, p in ENTITY_PATTERNS.items()),
    "f_similarities": """SELECT seq, ord, round(1 - levenshtein(a, b) * 1e0 / greatest(length(a), length(b)), 6) AS lev,
      round(1 - levenshtein(ta, tb) * 1e0 / greatest(length(ta), length(tb)), 6) AS tsort, round(len(list_intersect(string_split(ta, ' '), string_split(tb, ' '))) * 1e0 / len(list_distinct(list_concat(string_split(ta, ' '), string_split(tb, ' ')))), 6) AS tset,
      round(len(list_intersect(ga, gb)) * 1e0 / len(list_distinct(list_concat(ga, gb))), 6) AS grams, round(jaro_winkler_similarity(a, b), 6) AS jw FROM (
      SELECT *, array_to_string(list_sort(list_filter(string_split_regex(a, '\\s+'), lambda t: t <> '')), ' ') AS ta, array_to_string(list_sort(list_filter(string_split_regex(b, '\\s+'), lambda t: t <> '')), ' ') AS tb,
        list_distinct(list_transform(range(1, length(a) - 1), lambda i: substring(a, i, 3))) AS ga, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substring(b, i, 3))) AS gb
      FROM (SELECT seq, ord, strip_accents(upper(label)) AS a, reference AS b FROM payments p JOIN invoices i ON p.did = i.did) q) r""",
    "k_credit_note": """SELECT seq, ord, cid, CASE WHEN kind = 0 THEN 'R-M007' ELSE 'R-M006' END AS rule, CASE WHEN kind = 0 THEN 0.97e0 ELSE 0.95e0 END AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ord, kind, cid) AS k FROM (
        SELECT p.seq, i.ord, c.cid, CASE WHEN px = a - c THEN 0 WHEN 100 * abs(px - (a - c)) < a THEN 1 END AS kind
        FROM (SELECT *, CASE WHEN seq % 10 = 9 THEN x - 123457 ELSE x END AS px FROM payments) p JOIN invoices i ON p.did = i.did JOIN credits c ON p.did = c.did WHERE a > c) t WHERE kind IS NOT NULL) u WHERE k = 1""",
    "k3_multi_credit": """WITH t AS (SELECT did, a, i FROM (SELECT did, a, row_number() OVER (PARTITION BY did ORDER BY ord) AS i FROM invoices) q WHERE i <= 10),
      g AS (SELECT seq, g.did, x - c AS x FROM grouped g JOIN (SELECT did, arg_min(c, cid) AS c FROM credits GROUP BY did) c ON g.did = c.did),
      s2 AS (SELECT a.did, [a.i, b.i] AS st, a.a + b.a AS s, b.i AS l FROM t a JOIN t b ON a.did = b.did AND a.i < b.i),
      s3 AS (SELECT s2.did, list_append(st, t.i) AS st, s + t.a AS s, t.i AS l FROM s2 JOIN t ON s2.did = t.did AND t.i > l),
      s4 AS (SELECT s3.did, list_append(st, t.i) AS st, s + t.a AS s, t.i AS l FROM s3 JOIN t ON s3.did = t.did AND t.i > l),
      u AS (SELECT 2 AS n, * FROM s2 UNION ALL SELECT 3 AS n, * FROM s3 UNION ALL SELECT 4 AS n, * FROM s4)
      SELECT seq, n, array_to_string(st, ',') AS positions, cid FROM (SELECT seq, n, st, cid, row_number() OVER (PARTITION BY seq ORDER BY n, st, cid) AS k FROM u JOIN credits c ON u.did = c.did JOIN g ON g.did = u.did AND g.x = u.s - c.c) z WHERE k = 1""",
    "i1_installments": """SELECT seq, ord, pct FROM (SELECT seq, ord, CASE WHEN 100 * x > 0 AND abs(100 * x - 30 * a) < a THEN 30 WHEN abs(100 * x - 40 * a) < a THEN 40 WHEN abs(100 * x - 50 * a) < a THEN 50 WHEN abs(100 * x - 70 * a) < a THEN 70 END AS pct,
      row_number() OVER (PARTITION BY seq ORDER BY ord) AS k FROM payments p JOIN invoices i ON p.did = i.did WHERE contains(upper(label), 'ACOMPTE') AND x < a AND (abs(100 * x - 30 * a) < a OR abs(100 * x - 40 * a) < a OR abs(100 * x - 50 * a) < a OR abs(100 * x - 70 * a) < a)) t WHERE k = 1""",
    "j1_iso": f"""WITH {BYREF}, {VARIANTS}, f AS (SELECT seq, did, x, 0 AS pos, 'roc_ref' AS field, 1.00e0 AS conf, 'INV' || CAST(seq AS varchar) AS ref FROM payments WHERE seq % 3 = 0 UNION ALL SELECT seq, did, x, 1, 'rfb_ref', 1.00e0, 'NOTHING' FROM payments
        UNION ALL SELECT seq, did, x, 2, 'inv_number', 0.99e0, 'INV' || lpad(CAST(seq AS varchar), 8, '0') FROM payments WHERE seq % 3 = 1)
      SELECT seq, ord, 'R002-' || field AS rule, round(conf * CASE WHEN x = a THEN 1e0 ELSE 0.95e0 END, 4) AS confidence, x <> a AS amount_mismatch, least(x, a) AS allocated FROM (
        SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pos) AS k FROM (SELECT f.seq, f.did, f.x, pos, field, conf, coalesce(b.ord, v.ord) AS ord, CASE WHEN b.ord IS NOT NULL THEN b.did ELSE v.did END AS idid, CASE WHEN b.ord IS NOT NULL THEN b.a ELSE v.a END AS a
          FROM f LEFT JOIN byref b ON f.ref = b.ref LEFT JOIN variants v ON f.ref = v.ref) t WHERE ord IS NOT NULL AND idid = did) u WHERE k = 1""",
    "j2_reference": f"""WITH {REFS}, {BYREF} SELECT seq, ord, n, rule, CASE WHEN rule = 'R001-C' THEN 0.97e0 ELSE 1e0 END AS confidence FROM (
      SELECT seq, min(ord) AS ord, count(*) AS n, CASE WHEN sum(a) = x THEN CASE WHEN count(*) = 1 THEN 'R001-A' ELSE 'R001-D' END WHEN sum(ht) = x THEN 'R001-C' END AS rule
      FROM (SELECT DISTINCT r.seq, r.x, b.ord, b.a, b.ht FROM refs r JOIN byref b ON r.ref = b.ref AND r.did = b.did) t GROUP BY seq, x) u WHERE rule IS NOT NULL""",
    "j3_variants": f"""WITH {REFS}, {VARIANTS} SELECT seq, ord, 'R003' AS rule, 0.98e0 AS confidence FROM (SELECT r.seq, v.ord, row_number() OVER (PARTITION BY r.seq ORDER BY pos) AS k FROM refs r JOIN variants v ON r.ref = v.ref AND r.did = v.did AND r.x = v.a) t WHERE k = 1""",
    "j4_variant_index": f"WITH {VARIANTS} SELECT ord, count(*) AS n FROM variants GROUP BY ord",
    "j6_unique_amount": """SELECT seq, ord, 'R004-A' AS rule, 0.98e0 AS confidence FROM (SELECT p.seq, min(i.ord) AS ord, count(*) AS n, min(p.day - i.issue) AS age FROM payments p JOIN invoices i ON p.did = i.did AND p.x = i.a GROUP BY p.seq) t WHERE n = 1 AND age <= 120""",
    "j7_full_balance": f"WITH {BALANCES}, {BALANCE_PAYMENTS} SELECT seq, n, 'R004-B' AS rule, 0.96e0 AS confidence FROM bp JOIN bal ON bp.did = bal.did WHERE n > 1 AND x = s",
    "j8_month": """SELECT seq, ord, 'R004-C' AS rule, 0.95e0 AS confidence FROM (SELECT *, day - 28 AS d2 FROM payments) p JOIN (SELECT did, date_trunc('month', issue) AS m, min(ord) AS ord, min(a) AS a, min(due) AS due FROM invoices GROUP BY did, date_trunc('month', issue) HAVING count(*) = 1) i
      ON p.did = i.did AND date_trunc('month', d2) = i.m WHERE x = a AND d2 <= due + 15""",
    "j9_batch": """WITH b AS (SELECT did, issue, CAST(sum(a) AS bigint) AS x, min(ord) AS ord, count(*) AS n FROM invoices GROUP BY did, issue)
      SELECT seq, batch, n, 'R004-E' AS rule, 0.95e0 AS confidence FROM (SELECT p.ord AS seq, b.issue AS batch, b.n, row_number() OVER (PARTITION BY p.ord ORDER BY b.ord) AS k FROM b p JOIN b ON p.did = b.did AND p.x = b.x WHERE b.n > 1) t WHERE k = 1""",
    "j10_balance": f"WITH {BALANCES}, {BALANCE_PAYMENTS} SELECT seq, n, CASE WHEN x = s THEN 'R005' ELSE 'R005-NET' END AS rule, CASE WHEN x = s THEN 0.96e0 ELSE 0.95e0 END AS confidence FROM bp JOIN bal ON bp.did = bal.did WHERE x = s OR (c > 0 AND x = s - c)",
    "j11_order_number": _number("po_number", "R006", "0.96"),
    "j12_delivery_number": _number("bl_number", "R007", "0.95"),
    "b4_two_sum": f"""WITH {TOP}, {ASKED} SELECT seq, h, i, j, s FROM (SELECT seq, h, a.pos AS i, b.pos AS j, a.a + b.a AS s, row_number() OVER (PARTITION BY seq, h ORDER BY b.pos, a.a + b.a - target, a.pos DESC) AS k
      FROM asked q JOIN top a ON q.did = a.did JOIN top b ON q.did = b.did AND a.pos < b.pos WHERE abs(a.a + b.a - target) <= tol) t WHERE k = 1""",
    "b7_period_groups": """SELECT seq, w, n, 'R-SS-PERIOD' AS rule, 0.93e0 AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY w) AS k FROM (
      SELECT g.seq, w, count(*) AS n FROM grouped g JOIN invoices i ON g.did = i.did, (VALUES (1), (2), (3), (6)) v(w)
      WHERE year(issue) * 12 + month(issue) BETWEEN year(day) * 12 + month(day) - w - 1 AND year(day) * 12 + month(day) GROUP BY g.seq, g.x, w HAVING count(*) >= 2 AND abs(sum(a) - g.x) < 100) t) u WHERE k = 1""",
    "p1_delay_pattern": """SELECT seq, ord, 'R-TEMP' AS rule, 0.91e0 AS confidence FROM (SELECT p.seq, i.ord, row_number() OVER (PARTITION BY p.seq ORDER BY i.ord) AS k FROM payments p JOIN debtors d ON p.did = d.did JOIN invoices i ON p.did = i.did AND p.x = i.a
      WHERE avg_delay > 0 AND abs(p.day - (i.due + avg_delay)) <= 3) t WHERE k = 1""",
    "p2_label_period": """SELECT seq, n, 'R-TEMP-PERIOD' AS rule, 0.90e0 AS confidence FROM (SELECT p.seq, p.x, CAST(sum(a) AS bigint) AS s, count(*) AS n FROM payments p JOIN invoices i ON p.did = i.did
      AND year(issue) = year(day - CAST(30 + seq % 11 AS int)) AND month(issue) = month(day - CAST(30 + seq % 11 AS int)) GROUP BY p.seq, p.x) t WHERE s = x""",
    "d1_duplicates": f"""WITH q AS (SELECT seq, did, day, x, iban, label FROM payments UNION ALL SELECT seq + 20000000, did, day, x, iban, label FROM payments WHERE seq % 50 = 0)
      SELECT seq, coalesce(e, s) AS duplicate_of, CASE WHEN e IS NOT NULL THEN 'EXACT_DUPLICATE' ELSE 'SAME_DAY_SAME_AMOUNT' END AS alert, CASE WHEN e IS NOT NULL THEN 1e0 ELSE 0.9e0 END AS score FROM (
        SELECT seq, lag(seq) OVER (PARTITION BY iban, x, day, label_n ORDER BY seq) AS e, lag(seq) OVER (PARTITION BY did, day, x ORDER BY seq) AS s FROM (SELECT *, {LABEL} AS label_n FROM q) a) t WHERE e IS NOT NULL OR s IS NOT NULL""",
    "d2_near_duplicates": """WITH q AS (SELECT seq, did, day, x FROM payments UNION ALL SELECT seq + 20000000, did, day + 1, x + 20 FROM payments WHERE seq % 50 = 0)
      SELECT a.seq, b.seq AS other, CASE WHEN a.x = b.x AND a.day = b.day THEN 'SAME_DAY_SAME_AMOUNT' ELSE 'NEAR_DUPLICATE' END AS alert, CASE WHEN a.x = b.x AND a.day = b.day THEN 0.9e0 ELSE 0.85e0 END AS score
      FROM q a JOIN q b ON a.did = b.did AND a.seq > b.seq WHERE abs(a.x - b.x) < 100 AND abs(a.day - b.day) <= 3""",
    "m4_tfidf_idf": """WITH t AS (SELECT ord, lower(reference || ' ' || CAST(did AS varchar) || ' ' || CAST(a // 100 AS varchar) || '.' || lpad(CAST(a % 100 AS varchar), 2, '0')) AS c FROM invoices),
      g AS (SELECT DISTINCT ord, unnest(list_concat(list_concat(list_transform(range(1, length(c)), lambda i: substring(c, i, 2)), list_transform(range(1, length(c) - 1), lambda i: substring(c, i, 3))), list_transform(range(1, length(c) - 2), lambda i: substring(c, i, 4)))) AS g FROM t)
      SELECT g, round(ln((1 + (SELECT count(*) FROM t)) / (1e0 + count(*))) + 1, 9) AS idf FROM g GROUP BY g""",
    "l9_active_learning": "SELECT seq, x % 1000 / 1000e0 AS p FROM payments ORDER BY abs(x % 1000 / 1000e0 - 0.5e0), seq LIMIT 50",
    "l12_rank": """SELECT seq, ord, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, ord) AS rank FROM (
      SELECT seq, ord, round(0.6e0 * 0e0 + 0.4e0 * least(CASE WHEN abs(x - a) < 1 THEN 0.40e0 WHEN 100 * abs(x - a) < 5 * a THEN 0.30e0 WHEN 100 * abs(x - a) < 20 * a THEN 0.15e0 ELSE 0e0 END + 0.25e0 + CASE WHEN abs(day - due) <= 7 THEN 0.20e0 WHEN abs(day - due) <= 30 THEN 0.10e0 ELSE 0e0 END + 0e0, 1e0), 6) AS score
      FROM payments p JOIN invoices i ON p.did = i.did) t) u WHERE rank <= 5""",
    "l10_psi": """WITH v AS (SELECT seq % 2 AS side, x * 1e0 AS v FROM payments), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v), c AS (SELECT side, least(9, CAST(floor((v - lo) / ((hi - lo) / 10)) AS int)) AS k FROM v, b),
      n AS (SELECT count(*) FILTER (side = 0) AS ne, count(*) FILTER (side = 1) AS na FROM v), h AS (SELECT g.k, count(c.k) FILTER (side = 0) AS e, count(c.k) FILTER (side = 1) AS a FROM (SELECT unnest(range(10)) AS k) g LEFT JOIN c ON g.k = c.k GROUP BY g.k)
      SELECT round(sum((a * 1e0 / na - e * 1e0 / ne) * ln((a * 1e0 / na + 1e-6) / (e * 1e0 / ne + 1e-6))), 6) AS psi FROM h, n""",
    "r9_top_tokens": """WITH t AS (SELECT did, unnest(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(label), '\\b(FAC|INV)[A-Z]*[ /-]*[0-9O]+([ /-]+[0-9O]+)*', '<REF>', 'g'), '\\bPO[ /-]*[0-9]+', '<PO>', 'g'), '\\bBL[ /-]*[0-9]+', '<BL>', 'g'), '\\b[0-9]+\\b', '<NUM>', 'g'), '\\s+')) AS token FROM payments)
      SELECT did, token, n FROM (SELECT did, token, count(*) AS n, row_number() OVER (PARTITION BY did ORDER BY count(*) DESC, token) AS k FROM t WHERE token NOT IN ('', 'DE', 'DU', 'LA', 'LE', 'LES', 'DES', 'ET', 'THE', 'OF', 'AND', 'FOR') GROUP BY did, token) u WHERE k <= 15""",
    "r9_label_profile": "SELECT did, round(avg(length(label)), 6) AS mean_length, round(avg(CASE WHEN length(trim(label)) < 3 THEN 1e0 ELSE 0e0 END), 6) AS empty_share, round(avg(CASE WHEN len(string_split_regex(trim(label), '\\s+')) <= 2 THEN 1e0 ELSE 0e0 END), 6) AS short_share FROM payments GROUP BY did",
}
