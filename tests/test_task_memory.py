"""What one task holds doesn't grow with the tables."""

from pathlib import Path

import duckdb
from test_queries import DIR, plain

from panelwright.plans import base, jobs

PARTS = 4  # of the tests' session


def exchanges(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_and_sources_are_dealt_by_their_number(spark, monkeypatch):
    want = plain(jobs.d21_assembled(spark, DIR).collect())
    monkeypatch.setattr(base, "TASK_ROWS", 100)
    n = spark.read.parquet(f"{DIR}/orders.parquet").count()
    assert -(-n // 100) > PARTS
    lines = [x for x in exchanges(base.stats(spark, DIR)).splitlines() if "Exchange hashpartitioning(l_orderkey" in x]
    assert lines and all(f", {-(-n // 100)})" in x for x in lines)
    got = jobs.d21_assembled(spark, DIR)
    assert got.rdd.getNumPartitions() > len(want) * 6 // 100 and "l_orderkey" not in exchanges(got)
    assert plain(got.collect()) == want


def test_orders_without_a_date_have_no_sources(spark, tmp_path):
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        changed = "* replace (case when o_custkey % 7 = 0 then null else o_orderdate end as o_orderdate)" if p.stem == "orders" else "*"
        c.execute(f"copy (select {changed} from '{p}') to '{tmp_path / p.name}'")
        c.execute(f"create view {p.stem} as select * from '{tmp_path / p.name}'")
    got = jobs.d21_assembled(spark, str(tmp_path))
    names = sorted({*got.columns} - {"segment"})  # that of undated orders is the panel's matter
    assert plain(got.select(*names).collect()) == plain(c.sql(f"select {', '.join(names)} from ({jobs.ORACLES['d21_assembled']})").fetchall())
