"""Errors of all settings without repeating a row, against rows joined with their coefficients."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import linear


def test_errors_are_those_of_scored_rows(spark):
    rows = spark.range(600).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("g"), (F.col("id") % 5).cast("int").alias("yr"), F.when(F.col("id") % 9 > 0, F.col("id") * 37 % 101 * 1.0).alias("a"), (F.col("id") * 17 % 89 * 1.0).alias("b"), (F.col("id") * 53 % 97 * 1.0).alias("y"))
    fits = linear.fits(linear.fold_sums(rows, ["g"], "yr", ["a", "b"], "y"), ["g", "fold"], {"one": [0], "both": [0, 1]})
    keys = ["g", "fold", *linear.SETTING, "n_inputs"]
    want = linear.scored(rows, fits, ["g"], "yr", ["a", "b"]).groupBy(*keys).agg(F.avg(F.abs(F.col("predicted") - F.col("y"))).alias("mae"), F.count("*").alias("n"))
    got = {tuple(r[k] for k in keys): (r["mae"], r["n"]) for r in linear.errors(rows, fits, ["g"], "yr", ["a", "b"], "y").collect()}
    assert len(got) == want.count() > 0
    for r in want.collect():
        assert got[tuple(r[k] for k in keys)] == pytest.approx((r["mae"], r["n"]), rel=1e-12)
