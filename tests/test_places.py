"""Ranks and running sums in groups of any size, against pandas."""

import numpy as np
import pandas as pd
import pytest
from panelwright.operators import places
from panelwright.operators.places import Rank


@pytest.fixture(scope="module")
def data():
    """One hot group, one hot value, nulls in values and in a key, negative and repeated values."""
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    v = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(0, 20, n), 1))
    df = pd.DataFrame({"g": g, "k": range(n), "v": v, "w": rng.integers(1, 9, n)}).astype({"v": object, "g": object})
    df.loc[rng.random(n) < 0.05, "v"] = None
    df.loc[df.g == "c", "g"] = None
    return df


def test_ranks_equal_pandas(spark, data):
    df = spark.createDataFrame(data, "g string, k long, v double, w long").repartition(5)
    ranks = {"heavy": Rank("w"), "mean_down": Rank("v", descending=True), "mean_up": Rank("v"), "pct": Rank("v", "percent"), "low": Rank("v", "low", True)}
    got = places.with_ranks(df, ["g"], ranks).toPandas().sort_values("k")
    assert len(got) == len(data)
    by = data.assign(v=data.v.astype(float)).groupby("g", dropna=False).v
    assert np.allclose(got.heavy, data.groupby("g", dropna=False).w.rank())
    for name, want in (("mean_down", by.rank(ascending=False)), ("mean_up", by.rank()), ("pct", by.rank(pct=True)), ("low", by.rank(method="min", ascending=False))):
        assert np.allclose(got[name].astype(float).to_numpy(), want.to_numpy(), equal_nan=True), name


def test_places_are_whole_and_in_order(spark, data):
    df = spark.createDataFrame(data, "g string, k long, v double, w long").repartition(5)
    kinds = {"down": Rank("v", "first", True), "up": Rank("v", "first"), "mean": Rank("v", descending=True), "low": Rank("v", "low")}
    got = places.with_places(df, ["g"], "v", ["k"], kinds).toPandas()
    assert len(got) == len(data)
    for _, part in got.groupby("g", dropna=False):
        for name, up in (("down", False), ("up", True)):
            want = part.sort_values(["v", "k"], ascending=[up, True], na_position="last")
            assert want[name].tolist() == list(range(1, len(part) + 1))
        assert np.allclose(part["mean"].astype(float), part.v.rank(ascending=False), equal_nan=True)
        assert np.allclose(part["low"].astype(float), part.v.rank(method="min"), equal_nan=True)


def test_weighted_median_equals_brute_force(spark, data):
    known = data[data.v.notna()]
    got = {r["g"]: r["m"] for r in places.weighted_median(spark.createDataFrame(known, "g string, k long, v double, w long"), ["g"], "v", "w", "m").collect()}
    assert len(got) == 4
    for g, part in known.fillna({"g": "none"}).groupby("g"):
        part = part.sort_values("v")
        assert got[None if g == "none" else g] == part.v[part.w.cumsum() * 2 >= part.w.sum()].iloc[0]


def test_average_percent_and_lowest_rank(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 9.0), ("g", 4, None)], "g string, k int, v double")
    got = places.with_ranks(df, ["g"], {"a": Rank("v", descending=True), "p": Rank("v", "percent"), "m": Rank("v", "low", True)}).orderBy("k").select("k", "a", "p", "m").collect()
    assert [tuple(r) for r in got] == [(1, 2.5, 0.5, 2), (2, 2.5, 0.5, 2), (3, 1.0, 1.0, 1), (4, None, None, None)]


def test_tiers_equal_rank_quartiles(spark):
    sizes = (1, 4, 6, 9, 13)
    df = spark.createDataFrame([(f"g{n}", i, float(i * 7 % n)) for n in sizes for i in range(n)], "g string, k int, v double")
    got = {(r["g"], r["k"]): r["t"] for r in places.with_places(df, ["g"], "v", ["k"], {"t": Rank("v", "tier")}).collect()}
    assert got["g1", 0] == 1
    for n in sizes[1:]:
        want = pd.qcut(pd.Series([float(i * 7 % n) for i in range(n)]).rank(method="first"), 4, labels=[1, 2, 3, 4])
        assert [got[f"g{n}", i] for i in range(n)] == list(np.array(want))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, k int, v double")
    assert places.with_ranks(df, ["g"], {"a": Rank("v")}).count() == places.with_places(df, ["g"], "v", ["k"], {"p": Rank("v", "first")}).count() == 0
