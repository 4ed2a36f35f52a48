"""Panels, time joins, folds, models and metrics on small frames; leakage by changing the future."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import asof, calibrate, contracts, evaluate, folds, linear, panel, peers
from panelwright.sources import tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def seasons(spark):
    return spark.createDataFrame([("p", 2018, 10.0), ("p", 2019, 20.0), ("p", 2021, 30.0), ("p", 2022, 40.0), ("q", 2020, 5.0)], "e string, t int, v double")


def test_lags_respect_gaps(seasons):
    got = rows(seasons.select("e", "t", panel.exact_lag("v", "e", "t", 1), panel.recent_mean("v", "e", "t", 3), panel.prior_count("e", "t")), "e", "t")
    assert got == [("p", 2018, None, None, 0), ("p", 2019, 10.0, 10.0, 1), ("p", 2021, None, 15.0, 2), ("p", 2022, 30.0, 25.0, 3), ("q", 2020, None, None, 0)]


def test_changing_the_future_changes_no_input(seasons):
    inputs = lambda df: rows(df.select("e", "t", panel.exact_lag("v", "e", "t", 1), panel.weighted_history("v", "e", "t", (0.5, 0.33, 0.17))).filter("t <= 2021"), "e", "t")
    later = seasons.withColumn("v", F.when(F.col("t") >= 2021, 999.0).otherwise(F.col("v")))
    assert inputs(seasons) == inputs(later)


def test_target_counts_zero_rows(spark):
    stats = spark.createDataFrame([("p", 2024, "RB", 1, "g1", "AAA", 100.0, 1.0), ("p", 2024, "RB", 2, "g2", "BBB", 0.0, None), (None, 2024, "RB", 1, "g1", "AAA", 9.0, 9.0)], "e string, t int, s string, w int, g string, team string, yards double, tds double")
    got = panel.targets(stats, "e", "t", "s", "w", "g", "team", {"yards": 0.1, "tds": 6}, ["yards"]).collect()
    assert len(got) == 1 and (got[0]["total_score"], got[0]["target"], got[0]["team"], got[0]["n_occ"]) == (16.0, 8.0, "BBB", 2)
    assert panel.eligible(panel.targets(stats, "e", "t", "s", "w", "g", "team", {"yards": 0.1}, []), 3).count() == 0


def test_interval_needs_an_earlier_signature(spark):
    context = spark.createDataFrame([("p", 2020), ("p", 2023), ("q", 2020)], "k string, t int")
    deals = spark.createDataFrame([("p", 2019, 3, 5.0), ("p", 2020, 2, 9.0), ("p", 2018, 9, 1.0)], "k string, signed int, years int, value double")
    got = rows(asof.valid_interval(context, deals, "k", "t", "signed", "years", [-F.col("value")]).select("k", "t", "signed", "value", "n_same_period"), "k", "t")
    assert got == [("p", 2020, 2019, 5.0, 1), ("p", 2023, 2018, 1.0, 0), ("q", 2020, None, None, 0)]


def test_snapshot_before_cutoff(spark):
    df = spark.createDataFrame([(2024, "2024-08-01", "a"), (2024, "2024-08-20", "b"), (2024, "2024-08-20", "c"), (2024, "2024-09-09", "d")], "t int, taken string, who string")
    assert rows(asof.snapshot(df, "t", "taken", F.lit("2024-09-01")).select("who"), "who") == [("b",), ("c",)]


def test_contracts(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "K int, v string")
    with pytest.raises(contracts.ContractError):
        contracts.assert_unique(df, ["K"])
    with pytest.raises(contracts.ContractError):
        contracts.TableContract({"k": "k", "z": "z"}).apply(df)
    assert contracts.TableContract({"key": "k"}).apply(df).columns == ["key"]
    other = spark.createDataFrame([(1, "p"), (2, "q")], "K int, w string")
    assert rows(contracts.matched(df, other, ["K"]).select("K", "status"), "K", "status") == [(1, "both"), (1, "both"), (2, "right_only")]


def test_room_and_vacated(spark):
    df = spark.createDataFrame([("r", 1, 10), ("r", 2, 30), ("r", 3, None)], "g string, e int, v int")
    got = {r["e"]: r for r in peers.room(df, ["g"], "e", "v").collect()}
    assert (got[1]["others_total"], got[1]["room_share"], got[1]["others_max"], got[2]["others_max"], got[3]["room_rank"]) == (30, 0.25, 30, 10, None)
    left = peers.vacated(df, df.filter("e = 2"), ["g"], "e", "v").first()
    assert (left["vacated"], left["vacated_share"]) == (10, 0.25)


def test_folds_train_strictly_before(spark):
    df = spark.createDataFrame([("s", t, float(t)) for t in range(2000, 2006) for _ in range(10)], "seg string, t int, y double")
    f = folds.expanding_folds(df, "t", "seg", 20)
    assert rows(f.select("fold", "n_train"), "fold") == [(t, 10 * (t - 2000)) for t in range(2002, 2006)]
    roles = folds.with_roles(df, f, "t", "seg")
    assert roles.filter("role = 'train' and t >= fold").count() == 0
    assert rows(folds.inner_periods(f, "seg", 2, 2).select("fold", "inner_fold"), "fold", "inner_fold") == [(2004, 2002), (2004, 2003), (2005, 2003), (2005, 2004)]


def test_linear_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2)) * [1, 5] + [0, 3]
    y = 2 + x @ [1.5, -0.5] + rng.normal(size=80)
    data = [("s", 2018 + i % 2, float(a), float(b) if i % 9 else None, float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*data, ("s", 2020, 0.0, 0.0, 0.0)], "seg string, t int, a double, b double, y double")
    keys, both = ["seg", "fold"], {"both": [0, 1]}
    g = linear.fold_sums(df, ["seg"], "t", ["a", "b"], "y").filter("fold = 2020")
    fits = {(r["method"], r["alpha"], r["l1"]): r for r in linear.fits(g, keys, both, (10.0,), (0.1,), (0.5,)).collect()}
    filled = np.array([[a, np.nan if b is None else b] for *_, a, b, _ in data])
    filled[np.isnan(filled[:, 1]), 1] = np.nanmedian(filled[:, 1])
    z = (filled - filled.mean(0)) / filled.std(0)
    assert np.allclose(fits["ols", 0, 0]["coef_z"], np.linalg.lstsq(z, y - y.mean(), rcond=None)[0])
    assert np.allclose(fits["ridge", 10, 0]["coef_z"], np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y - y.mean())))
    w = np.array(fits["net", 0.1, 0.5]["coef_z"])
    slope = -z.T @ (y - y.mean() - z @ w) / 80 + 0.1 * 0.5 * w
    assert np.all(np.abs(slope[w != 0] + 0.05 * np.sign(w[w != 0])) < 1e-6)
    units = {r["feature"]: r for r in linear.original_units(linear.fits(g, keys, both, ()), keys, ["a", "b"]).collect()}
    back = units["a"]["intercept"] + filled @ [units["a"]["coefficient"], units["b"]["coefficient"]]
    assert np.allclose(back, y.mean() + z @ fits["ols", 0, 0]["coef_z"])
    audit = linear.rank_audit(g, keys).first()
    assert (audit["matrix_rank"], audit["deficiency"]) == (2, 0)


def test_metrics(spark):
    df = spark.createDataFrame([("s", 10.0, 12.0), ("s", 20.0, 18.0)], "seg string, actual double, predicted double")
    m = evaluate.metrics(evaluate.diagnosed(df, ["seg"]), ["seg"], 1).first()
    assert (m["mae"], m["rmse"], round(m["r2"], 9), m["spearman"], m["top_overlap"]) == (2.0, 2.0, 0.84, 1.0, 1.0)


def test_stability(spark):
    df = spark.createDataFrame([("x", i, c) for i, c in enumerate([1.0, -1.0, 0.0, -2.0, 2.0])], "f string, fold int, coefficient double")
    got = evaluate.stability(df, ["f"], "fold").first()
    assert got["sign_changes"] == 2 and got["unstable"]


def test_bootstrap_depends_on_the_seed_only(spark):
    per = spark.createDataFrame([("s", 1, 2.0, 2), ("s", 2, 6.0, 2)], "g string, t int, total double, n int")
    a = evaluate.block_bootstrap(per, ["g"], "t", "total", "n", 400).first()
    b = evaluate.block_bootstrap(per.repartition(3), ["g"], "t", "total", "n", 400).first()
    assert a == b and (a["pooled_low"], a["pooled_high"]) == (1.0, 3.0)


def test_power_calibration_recovers_parameters_of_the_past(spark):
    past = [("s", 1, float(r), 20.0 * r**-0.5) for r in range(1, 31)]
    df = spark.createDataFrame([*past, *(("s", 2, float(r), 7.0) for r in range(1, 31))], "g string, t int, r double, y double")
    folds = spark.createDataFrame([("s", 2), ("s", 3)], "g string, fold long")
    got = {r["fold"]: r for r in calibrate.power_calibration(df, "g", "t", "r", "y", folds).collect()}
    assert abs(got[2]["beta"] - 0.5) < 0.011 and got[2]["mae"] < 0.2 and got[2]["n"] == 30
    assert got[3]["n"] == 60 and got[3]["mae"] > got[2]["mae"]
    assert calibrate.power_calibration(df.filter("r <= 10"), "g", "t", "r", "y", folds.filter("fold = 2")).count() == 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert tables.publish(df, str(tmp_path / "t"), ["k"]).count() == 2
    with pytest.raises(contracts.ContractError):
        tables.publish(df.union(df), str(tmp_path / "u"), ["k"])
    tables.preserve(df.limit(0), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "r.csv").write_text('season,rank\n2024,"1"\n2025,2\n')
    assert rows(tables.strict_csv(spark, str(tmp_path / "r.csv"), {"season": "int", "rank": "int"}), "season") == [(2024, 1), (2025, 2)]
    with pytest.raises(Exception):
        tables.strict_csv(spark, str(tmp_path / "r.csv"), {"season": "int", "rank": "int"}, F.expr("rank < 2")).collect()
    (tmp_path / "adp_2024.json").write_text('{"status": "ok", "meta": {"a": "b"}, "players": [{"name": "x", "adp": 1.5}]}')
    got = tables.json_archive(spark, str(tmp_path / "adp_2024.json"), "players", "name string, adp double").first()
    assert (got["period"], got["name"], got["adp"], got["meta"]) == (2024, "x", 1.5, {"a": "b"})
    before = tables.manifest(spark, str(tmp_path / "r.csv"))
    assert before.first()["bytes"] == 28 and tables.changed_files(before, before).count() == 0
