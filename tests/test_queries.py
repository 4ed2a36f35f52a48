"""Every registered query of the engine against its SQL in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from panelwright.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES)))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR)
    want = duck.sql(registry.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = plain(got.select(*names).collect())
    b = plain(duck.sql(f"select {', '.join(names)} from ({registry.ORACLES[name]})").fetchall())
    assert a == b
