"""Corrections in numpy against the same as Spark columns, and no more of them than are chosen."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import calibrate

SCHEMA = "segment string, fold int, count double, count_mean double, count_std double, burden double, share double, share_mean double, share_std double, base double, actual double"


@pytest.fixture
def rows(spark):
    data = [("AB"[i % 2], i % 3, i % 7 * 1.0, 2.5, None if i % 5 == 0 else 1.5, i % 11 * 1.0, None if i % 4 == 0 else i / 40, 0.5, 0.0 if i % 6 == 0 else 0.2, i % 13 - 2.0, None if i % 17 == 0 else i % 19 * 0.7) for i in range(120)]
    return spark.createDataFrame(data, SCHEMA)


def test_grid_errors_are_those_of_the_columns(rows):
    got = {(r["segment"], r["fold"], r["name"], r["setting"]): (r["n"], r["base_mae"], r["mae"]) for r in calibrate.grid_errors(rows, ["segment", "fold"], "base", "actual").collect()}
    error = lambda name, s: F.avg(F.abs(F.col("actual") - F.col("base") - calibrate.bounded(name, s)))
    assert len(got) == 6 * sum(map(len, calibrate.GRIDS.values()))
    for name, grid in calibrate.GRIDS.items():
        for r in rows.groupBy("segment", "fold").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("actual") - F.col("base"))).alias("b"), *(error(name, s).alias(f"e{i}") for i, s in enumerate(grid))).collect():
            for i in range(len(grid)):
                assert got[r["segment"], r["fold"], name, i] == pytest.approx((r["n"], r["b"], r[f"e{i}"]), rel=1e-12)


def test_mean_correction_makes_chosen_ones_only(rows, monkeypatch):
    grids = {**calibrate.GRIDS, "burden": [{"p_penalty": 0.1}, {"no_such": 1.0}]}  # a setting that would fail if it were made
    chosen = F.when(F.col("fold") == 0, F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).alias("setting")) for n, i in (("count", 2), ("burden", 0), ("gated", 9)))))
    got = calibrate.mean_correction(rows.withColumn("chosen", chosen), "chosen", "got", grids)
    three = [calibrate.bounded("count", grids["count"][2]), calibrate.bounded("burden", grids["burden"][0]), calibrate.bounded("gated", grids["gated"][9])]
    want = F.when(F.col("fold") == 0, F.least(F.lit(0.75), F.greatest(F.lit(-0.75), (three[0] + three[1] + three[2]) / 3))).otherwise(0.0)
    assert got.filter(F.abs(F.col("got") - want) > 1e-12).isEmpty()
    assert got.count() == 120
