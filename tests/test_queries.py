"""Every registered matching and reporting query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from ledgerlink.plans import registry

TABLES = "customer orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else v)
    return frame.sort_values(list(frame.columns), key=lambda s: s.astype(str)).reset_index(drop=True).astype(str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf_dir, oracle, name):
    got = normal(registry.QUERIES[name](spark, sf_dir).toPandas())
    want = normal(oracle.sql(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head().to_string()


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES


def test_depletion_uses_an_invoice_once(spark, sf_dir):
    rows = registry.QUERIES["x4_depletion"](spark, sf_dir).collect()
    assert rows and len({r.ord for r in rows}) == len(rows) == len({r.seq for r in rows})


def test_cascade_covers_every_payment(spark, sf_dir):
    rows = registry.QUERIES["cascade"](spark, sf_dir).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert {1, 2, 6} <= {r.layer for r in rows}


def test_meet_in_the_middle_finds_what_pairs_find(spark, sf_dir):
    two = {(r.seq, r.h) for r in registry.QUERIES["b4_two_sum"](spark, sf_dir).where("seq % 4 = 1").collect()}
    all_ = {(r.seq, r.h): r.n for r in registry.QUERIES["b6_meet_in_the_middle"](spark, sf_dir).collect()}
    assert two <= set(all_) and all(all_[k] == 2 for k in two)
