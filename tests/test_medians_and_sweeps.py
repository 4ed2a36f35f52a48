"""Radix medians, interval sweeps, row bootstraps and cohorts against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import asof, evaluate, medians


def test_medians_of_groups(spark):
    rng = np.random.default_rng(0)
    values = [*rng.normal(size=101), *(rng.normal(size=40) * 1e9), 0.0, -0.0, 5.0, 5.0, 5.0, -1e-300, 1e300]
    rows = [("a" if i % 3 else None, float(v), None if i % 5 == 0 else float(i % 4)) for i, v in enumerate(values)] + [("none", None, None), ("nan", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = {r["g"]: (r["med_v"], r["med_w"]) for r in medians.medians(df, ["g"], ["v", "w"]).collect()}
    for g in ("a", None):
        own = [r for r in rows if r[0] == g]
        assert got[g] == (np.median([r[1] for r in own]), np.median([r[2] for r in own if r[2] is not None]))
    assert "none" not in got and got["nan"] == (None, 1.0)


def test_medians_of_folds(spark):
    rng = np.random.default_rng(1)
    rows = [(s, int(p), float(round(rng.normal(), 1))) for s in "ab" for p in range(5) for _ in range(int(rng.integers(1, 20)))]
    folds = spark.createDataFrame([(s, f) for s in "ab" for f in (1, 3, 4)], "s string, fold long")
    got = {(r["s"], r["fold"]): r["med_v"] for r in medians.medians(spark.createDataFrame(rows, "s string, p long, v double"), ["s"], ["v"], "p", folds).collect()}
    assert got == {(s, f): pytest.approx(np.median([v for g, p, v in rows if g == s and p < f])) for s in "ab" for f in (1, 3, 4)}


@pytest.mark.parametrize("seed", range(3))
def test_sweep_equals_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    intervals = [(int(rng.integers(0, 4)), int(rng.integers(2000, 2010)), None if rng.random() < 0.05 else int(rng.integers(1, 6)), int(rng.integers(0, 3)), i) for i in range(120)]
    context = [(k, t) for k in range(5) for t in range(1999, 2016)]
    got = asof.valid_interval(
        spark.createDataFrame(context, "k int, t int"), spark.createDataFrame(intervals, "k int, s int, years int, price int, occ int"), "k", "t", "s", "years", [-F.col("price"), F.col("occ")]
    ).collect()
    assert len(got) == len(context)
    for r in got:
        usable = sorted((-s, -price, occ) for k, s, years, price, occ in intervals if k == r["k"] and years is not None and s <= r["t"] - 1 and s + years - 1 >= r["t"])
        assert (r["occ"] is None) == (not usable) and (not usable or (-r["s"], -r["price"], r["occ"]) == usable[0])
        assert r["n_same_period"] == sum(k == r["k"] and s == r["t"] for k, s, *_ in intervals)


def test_a_hot_key_costs_its_distinct_times(spark):
    """Ten thousand equal intervals of one key are one event of the sweep."""
    many = spark.range(10_000).selectExpr("1 k", "2000 + id % 5 s", "3 years", "id price", "id occ")
    context = spark.range(2000, 2010).selectExpr("1 k", "id t")
    got = asof.valid_interval(context, many, "k", "t", "s", "years", [-F.col("price"), F.col("occ")])
    assert [(r["t"], r["price"]) for r in got.orderBy("t").collect()][:4] == [(2000, None), (2001, 9995), (2002, 9996), (2003, 9997)]


def test_bootstrap_repeats_and_covers(spark):
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], i * 7919, float(v)) for i, v in enumerate(rng.normal(3, 2, 600))]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    a = {r["g"]: r for r in evaluate.row_bootstrap(df, ["g"], "k", "v", 2000).collect()}
    b = {r["g"]: r for r in evaluate.row_bootstrap(df.repartition(5), ["g"], "k", "v", 2000).collect()}
    frame = pd.DataFrame(rows, columns=["g", "k", "v"])
    for g, own in frame.groupby("g"):
        assert a[g]["low"] == pytest.approx(b[g]["low"]) and a[g]["n"] == 300
        w = evaluate.poisson_draws(own.k.to_numpy(), 2000, 446)
        m = (w * own.v.to_numpy()[:, None]).sum(0) / w.sum(0)
        assert a[g]["low"] == pytest.approx(np.percentile(m, 2.5)) and a[g]["high"] == pytest.approx(np.percentile(m, 97.5))
        half = 1.96 * own.v.std(ddof=0) / np.sqrt(300)
        assert abs(own.v.mean() - half - a[g]["low"]) < 0.06 and abs(own.v.mean() + half - a[g]["high"]) < 0.06


def test_draws_are_poisson():
    w = evaluate.poisson_draws(np.arange(500), 2000, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:50])[np.triu_indices(50, 1)]).max() < 0.12


def test_cohort_of_three_tables(spark):
    t = {n: spark.createDataFrame(rows, "k int, v double") for n, rows in {"x": [(1, 1.0), (2, 2.0), (3, 3.0), (None, 9.0)], "y": [(1, 4.0), (2, None), (3, float("nan")), (None, 8.0)], "z": [(1, 5.0), (2, 1.0), (None, float("inf"))]}.items()}
    assert [tuple(r) for r in evaluate.same_cohort(t, ["k"], "v").collect()] == [(1, 1.0, 4.0, 5.0)]
    assert {r["k"]: (r["__in"], r["__finite"]) for r in evaluate.present(t, ["k"], "v").collect()} == {1: (7, 7), 2: (7, 5), 3: (3, 1), None: (7, 3)}
