"""Debtors, invoices, payments and credit notes derived from the order tables; integer arithmetic only, money in cents.

The SQL is written once in the dialect-free subset that both Spark and an SQL oracle read; `duck()` rewrites the few
functions whose names differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DEBTORS = """
SELECT c_custkey AS did, c_name AS name,
  CASE c_nationkey % 8 WHEN 0 THEN 'FR' WHEN 1 THEN 'DE' WHEN 2 THEN 'IT' WHEN 3 THEN 'US' WHEN 4 THEN 'MA' WHEN 5 THEN 'TR' WHEN 6 THEN 'GB' ELSE 'IN' END AS country,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'BTP' ELSE c_mktsegment END AS sector,
  CASE WHEN c_custkey % 7 = 1 THEN 2 ELSE 0 END AS discount_pct, CASE WHEN c_custkey % 7 = 2 THEN 5 ELSE 0 END AS retention_pct,
  CASE WHEN c_custkey % 7 = 3 THEN 3 ELSE 0 END AS rfa_pct, CAST(c_custkey % 10 AS int) AS avg_delay, CAST(c_custkey % 100 AS int) AS risk_pct,
  CASE c_nationkey % 8 WHEN 0 THEN 'FR' WHEN 1 THEN 'DE' WHEN 2 THEN 'IT' WHEN 3 THEN 'US' WHEN 4 THEN 'MA' WHEN 5 THEN 'TR' WHEN 6 THEN 'GB' ELSE 'IN' END || lpad(CAST(c_custkey AS string), 20, '0') AS iban
FROM customer
"""

INVOICES = """
SELECT o_orderkey AS ord, o_custkey AS did, CAST(round(o_totalprice * 100) AS bigint) AS a, CAST(round(o_totalprice * 100) AS bigint) * 5 div 6 AS ht,
  CAST(o_orderdate AS date) AS issue, date_add(CAST(o_orderdate AS date), 30) AS due,
  CASE WHEN o_orderkey % 2 = 0 THEN 'FAC-' || CAST(year(o_orderdate) AS string) || '-' || lpad(CAST(o_orderkey AS string), 8, '0') ELSE 'INV-' || lpad(CAST(o_orderkey AS string), 8, '0') END AS reference,
  CASE WHEN o_orderkey % 4 = 0 THEN 'PO' || lpad(CAST(o_orderkey div 8 AS string), 6, '0') END AS po_number,
  CASE WHEN o_orderkey % 4 = 1 THEN 'BL' || lpad(CAST(o_orderkey div 8 AS string), 6, '0') END AS bl_number
FROM orders
"""

_AMOUNT = """CASE o_orderkey % 10 WHEN 0 THEN a WHEN 1 THEN a - 50 WHEN 2 THEN a - 2800 WHEN 3 THEN a * 98 div 100 WHEN 4 THEN a * 95 div 100 WHEN 5 THEN a * 30 div 100
  WHEN 6 THEN a * 80 div 100 WHEN 7 THEN a * 5 div 6 WHEN 8 THEN a + 7 ELSE a + 123457 END"""

PAYMENTS = f"""
SELECT seq, did, day, x, iban,
  CASE WHEN seq % 7 = 0 THEN replace(label, '0', 'O') WHEN seq % 11 = 0 THEN substring(label, 1, length(label) - 1) ELSE label END AS label
FROM (
  SELECT o_orderkey AS seq, o_custkey AS did, date_add(CAST(o_orderdate AS date), CAST(30 + o_orderkey % 11 AS int)) AS day,
    {_AMOUNT} AS x, 'FR' || lpad(CAST(o_custkey AS string), 20, '0') AS iban,
    CASE o_orderkey % 5 WHEN 0 THEN 'VIR DE CLIENT ' || ref WHEN 1 THEN 'RÉGLT ' || ref WHEN 2 THEN 'Paiement ' || ref || ' mars 1996' WHEN 3 THEN 'VIREMENT OUR ' || ref ELSE 'ACOMPTE ' || ref END AS label
  FROM (SELECT o.*, CAST(round(o_totalprice * 100) AS bigint) AS a,
    CASE WHEN o_orderkey % 2 = 0 THEN 'FAC-' || CAST(year(o_orderdate) AS string) || '-' || lpad(CAST(o_orderkey AS string), 8, '0') ELSE 'INV-' || lpad(CAST(o_orderkey AS string), 8, '0') END AS ref
    FROM orders o) b
) c
"""

#: Two or three invoices of a debtor in a row, paid at once.
GROUPED = """
SELECT 10000000 + ord AS seq, did, date_add(issue, 35) AS day, x, n FROM (
  SELECT ord, did, issue, rn, CASE WHEN rn % 3 = 1 THEN 2 ELSE 3 END AS n,
    CASE WHEN rn % 3 = 1 THEN a + lead(a, 1) OVER w ELSE a + lead(a, 1) OVER w + lead(a, 2) OVER w END AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY did ORDER BY ord) AS rn FROM invoices) r WINDOW w AS (PARTITION BY did ORDER BY ord)
) g WHERE x IS NOT NULL AND rn <= 4
"""

CREDITS = """
SELECT l_orderkey AS cid, o_custkey AS did, CAST(round(l_extendedprice * 100) AS bigint) div 20 AS c
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linenumber = 1
"""

VIEWS = {"debtors": DEBTORS, "invoices": INVOICES, "payments": PAYMENTS, "grouped": GROUPED, "credits": CREDITS}
TABLES = ("customer", "orders", "lineitem", "events", "nation", "documents")


def duck(sql: str) -> str:
    """The same query for the oracle's dialect."""
    sql = re.sub(r"\bdiv\b", "//", sql)
    sql = re.sub(r"\bAS string\b", "AS varchar", sql)
    sql = re.sub(r"date_add\(((?:[^()]|\([^()]*\))+), (CAST\((?:[^()]|\([^()]*\))+ AS int\)|-?\d+)\)", r"(\1 + \2)", sql)
    sql = re.sub(r"datediff\(([\w.]+), ([\w.]+)\)", r"(\1 - \2)", sql)
    sql = re.sub(r"\bcollect_list\(", "list(", sql)
    sql = re.sub(r"\bstddev_pop\(", "stddev_pop(", sql)
    return sql


def needed(sql: str) -> list[str]:
    """Views that a query uses, each after those it uses itself."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in out and VIEWS[name] is not text:
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def with_views(sql: str) -> str:
    """sql behind the views it uses, as one statement."""
    sql = sql.strip()
    views = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed(sql))
    if not views:
        return sql
    return f"WITH {views}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {views} {sql}"


def oracle(sql: str) -> str:
    return duck(with_views(sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the views and tables of sf_dir."""
    full = with_views(sql)
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", full)}
    full = full.replace("{", "{{").replace("}", "}}")
    for t in used:
        full = re.sub(rf"(\b(?:FROM|JOIN)\s+){t}\b", rf"\1{{{t}}}", full)
    return spark.sql(full, **used)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")
